import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinetrace.llm import ppm


class Brute:
    """Prediction by partial matching with plain counters, byte by byte."""

    def __init__(self, texts, least):
        self.counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            seq = [ppm.PAD] * ppm.ORDER + list(t) + [ppm.END]
            for i in range(ppm.ORDER, len(seq)):
                for k in range(ppm.ORDER + 1):
                    self.counts[k][tuple(seq[i - k : i])][seq[i]] += 1
        self.full = [{c: sum(n.values()) for c, n in level.items()} for level in self.counts]
        for k, level in enumerate(self.counts):
            kept = {c: Counter({s: n for s, n in own.items() if n >= least}) for c, own in level.items()}
            self.counts[k] = {c: own for c, own in kept.items() if own}

    def log10(self, t):
        seq = [ppm.PAD] * ppm.ORDER + list(t) + [ppm.END]
        total = 0.0
        for i in range(ppm.ORDER, len(seq)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                context = tuple(seq[i - k : i])
                own = self.counts[k].get(context)
                if own is None:
                    continue
                # pruned symbols weigh with the escape, where the context was counted as a gram itself
                known = k > 0 and self.counts[k - 1].get(context[:-1], {}).get(context[-1], 0) > 0
                pruned = self.full[k][context] - sum(own.values()) if known else 0
                fresh = {s: n for s, n in own.items() if s not in excluded}
                escape = len(fresh) + pruned
                mass = sum(fresh.values()) + escape
                if seq[i] in fresh:
                    total += math.log10(fresh[seq[i]] / mass)
                    break
                total += math.log10(max(escape, 1) / max(mass, 1))
                excluded |= set(own)
            else:
                total -= math.log10(ppm.ALPHABET - len(excluded))
        return total


def corpus(n=60):
    rnd = random.Random(4)
    parts = ["ab", "ra", "ca", "da", "bra", "é", "zu", " ", " the ", "\n"]
    return [(k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("bits", [30, 10, 7])
def test_scores_equal_brute_force(bits):
    texts = [t.encode() for _, t in corpus()]
    codes = np.concatenate([c for c, _, _ in ppm._blocks(texts)])
    least = max(1, -(-len(codes) // (1 << bits)))
    grams = []
    for k in range(ppm.ORDER + 1):
        c, n = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        grams.append((c[n >= least], n[n >= least]))
    trie, brute = ppm.Trie(grams), Brute(texts, least)
    new = [b"", b"abracadabra", "zué the".encode(), bytes(range(1, 200)), b"x" * 50]
    got = trie.log10(texts[:10] + new)
    assert got == pytest.approx([brute.log10(t) for t in texts[:10] + new], rel=1e-5)


@pytest.mark.parametrize("context", [b"", b"abra", b" the", b"qqqq"])
def test_next_bytes_sum_to_one(context):
    texts = [t.encode() for _, t in corpus()]
    codes = np.concatenate([c for c, _, _ in ppm._blocks(texts)])
    grams = [np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.ORDER + 1)]
    trie = ppm.Trie([(c[n > 1], n[n > 1]) for c, n in grams])
    raw = bytes([ppm.PAD] * ppm.ORDER) + context
    each = [int.from_bytes(raw[-ppm.ORDER :] + bytes([b]), "big") for b in range(256) if b != ppm.PAD]
    assert (10 ** trie._logs(np.array(each, np.uint64))).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("scale", [1, 10**9, 10**11])
def test_next_bytes_sum_to_one_at_any_size_of_the_counts(scale):
    """Frequent short contexts above rare long ones: what is left after an escape is exact."""
    texts = [t.encode() for _, t in corpus()] + [b"qat", b"qaz zu"]
    codes = np.concatenate([c for c, _, _ in ppm._blocks(texts)])
    grams = [np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.ORDER + 1)]
    # every gram of up to three bytes was seen so many times more, the long ones only here
    low = [(c, n * scale) for c, n in grams[: ppm.NEAR]]
    trie = ppm.Trie(low + grams[ppm.NEAR :], ppm.Trie(low))
    for context in (b"qat", b"qa", b"abra", b" the", b"", b"zu"):
        raw = bytes([ppm.PAD] * ppm.ORDER) + context
        each = [int.from_bytes(raw[-ppm.ORDER :] + bytes([b]), "big") for b in range(256) if b != ppm.PAD]
        assert (10 ** trie._logs(np.array(each, np.uint64))).sum() == pytest.approx(1, abs=1e-6)


def test_spans_of_a_long_text_are_one_text(monkeypatch):
    texts = [b"abc" * 50, b"", b"q", b"hello world " * 30]
    want = [np.concatenate([c for c, _, _ in ppm._blocks([t])]) for t in texts]
    monkeypatch.setattr(ppm, "BLOCK", 17)
    parts = defaultdict(list)
    for codes, starts, owners in ppm._blocks(texts):
        for own, part in zip(owners, np.split(codes, starts[1:])):
            parts[int(own)].append(part)
    assert all((np.concatenate(parts[i]) == w).all() for i, w in enumerate(want))


def test_query_rows(docs, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 5)
    rows = corpus(40) + [(None, None), (90, ""), (91, "Unseen words the THE"), (7, "the the"), (7, "the the")]
    df = docs(rows, ["score", "rare", "word", "at", "n"])
    training = df.filter(~ppm.held_out(df["doc_id"]))
    got = ppm.score(df, training).collect()

    def tokens(t):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]

    counts = Counter(w for k, t in rows if zlib.crc32(str("" if k is None else k).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for k, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((k, len(own), sum(counts[w] > 0 for w in own), n, round(base, 8)))
    found = [(r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in got)


def test_no_training_rows(docs):
    got = ppm.score(docs([(1, "ab")]), docs([])).first()
    assert got["n_known"] == 0 and got["train_tokens"] == 0 and got["score"] == pytest.approx(-3 * math.log10(255))
    assert ppm.score(docs([]), docs([])).count() == 0


@pytest.mark.parametrize("bits", [30, 6, 1])
def test_scores_use_every_count_at_any_size_of_the_shortcut(docs, monkeypatch, bits):
    monkeypatch.setattr(ppm.train, "__defaults__", ("text", bits))  # what is frequent enough to travel
    monkeypatch.setattr(ppm, "CHUNK", 50)
    monkeypatch.setattr(ppm, "BUCKET_GRAMS", 100)
    rows = corpus(40) + [(None, None), (90, ""), (91, "Unseen words THE"), (7, "the the"), (92, "zu\x00the ca" * 30)]
    training = docs(rows[:30] + [(None, None)])
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in ppm.score(docs(rows), training).collect()}
    brute = Brute([t.encode() for _, t in rows[:30]] + [b""], 1)
    want = {(k, len((t or "").split()) + 1): brute.log10((t or "").encode()) for k, t in rows}
    assert got == pytest.approx(want, rel=1e-5)
