"""Quality rules: base counts, and a linear-chain CRF over lines decoded by Viterbi.

Every line is content (1) or boilerplate (0).  The chain is trained on labelled documents: lines of
good documents are taken as content and lines of bad ones as boilerplate, apart from lines without
a word or equal to an earlier line, which are boilerplate anywhere.  The share of words in content
lines decides whether a document stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import slices, text_bytes

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_CONTENT = 0.5  # share of the words in content lines
MAX_LABELLED, MAX_LINES = 4_000, 400  # documents and spans of the fit, and lines of the longest span
EPOCHS, RATE, DECAY = 120, 0.1, 1e-3
SYMBOLS = b"#*$%&|<>"
_SPACES, _UPPER, _DIGITS = b" \t\n\x0b\f\r", bytes(range(65, 91)), bytes(range(48, 58))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    points = len(text.decode()) - _count(text, _SPACES)
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip():
            repeated += line in seen
            seen.add(line)
    covered = 0
    if len(words) > 3:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        _, at, n = np.unique(g, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        if twice.any():
            mark = np.zeros(len(words), bool)
            for d in range(3):
                mark[d : d + len(twice)] |= twice
            covered = int(mark.sum())
    return len(words), points, _count(text, SYMBOLS), repeated, covered


FEATURES = 24


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A bit set of features per line, and its number of words."""
    lines = text.split(b"\n")
    bits, sizes = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        symbols, upper, length = _count(line, SYMBOLS), _count(line, _UPPER), len(line) or 1
        same = sum(a == b for a, b in zip(words, words[1:]))
        bangs, bars = line.count(b"!"), line.count(b"|")
        on = (
            True,
            n == 0, 0 < n < 3, 3 <= n < 6, 6 <= n < 13, 13 <= n < 31, n > 30,
            symbols > 0, symbols > 0.2 * n, symbols > 0.8 * n,
            upper > 0.3 * length, upper > 0.6 * length,
            bangs > 0.2 * n, bars > 0.2 * n,
            same > 0.1 * n, same > 0.4 * n,
            _count(line, _DIGITS) > 0.2 * length,
            line.rstrip()[-1:] in (b".", b"?", b":"),
            line in seen,
            length > 12 * n, length < 4 * n,
            b"://" in line or b"@" in line,
            n > 0 and line[:1].islower(),
            len(set(words)) < 0.5 * n,
        )
        bits[i] = sum(1 << k for k, x in enumerate(on) if x)
        sizes[i] = n
        if n:
            seen.add(line)
    return bits, sizes


@dataclass
class Chain:
    """Weights of content over boilerplate per feature, and of each step between labels."""

    weights: np.ndarray
    steps: np.ndarray  # [from, to]


def _emissions(chain: Chain, bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(FEATURES)) & 1) @ chain.weights


def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order from the longest text, and how many texts have a line at each step."""
    sizes = np.array([len(r) for r in rows])
    order = np.argsort(-sizes, kind="stable")
    steps = np.arange(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -steps, side="left")


def viterbi(chain: Chain, rows: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of every text's lines; ties go to content.

    Texts advance side by side, longest first, so a step is one array operation.
    """
    order, active = _layout(rows)
    flat = np.concatenate([rows[i] for i in order]) if rows else np.empty(0, np.int64)
    starts = np.concatenate(([0], np.cumsum([len(rows[i]) for i in order]))).astype(np.int64)
    score = np.empty(len(flat))
    for i in range(0, len(flat), 65_536):
        score[i : i + 65_536] = _emissions(chain, flat[i : i + 65_536])
    came = np.zeros((len(flat), 2), np.int8)
    best = np.zeros((len(rows), 2))
    s = chain.steps
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            for to in (0, 1):
                came[at, to] = best[:n, 1] + s[1, to] >= best[:n, 0] + s[0, to]
            best[:n] = np.maximum(best[:n, :1] + s[0], best[:n, 1:] + s[1])
        best[:n, 1] += score[at]
    labels = np.zeros(len(flat), np.int8)
    last = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        at = starts[: active[t]] + t
        labels[at] = last[: active[t]]
        last[: active[t]] = came[at, last[: active[t]]]
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(rows)
    for k, i in enumerate(order):
        out[i] = labels[starts[k] : starts[k + 1]]
    return out


def fit(rows: list[np.ndarray], labels: list[np.ndarray]) -> Chain:
    """Maximum penalised conditional likelihood; marginals by forward and backward sums."""
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    if not rows:
        chain.weights[0] = 1.0  # nothing known: content
        return chain
    order, active = _layout(rows)
    longest = len(active)
    bits = np.zeros((longest, len(rows)), np.int64)
    gold = np.zeros((longest, len(rows)), np.int64)
    for k, i in enumerate(order):
        bits[: len(rows[i]), k], gold[: len(rows[i]), k] = rows[i], labels[i]
    there = np.arange(len(rows))[None, :] < active[:, None]
    x = ((bits[there][:, None] >> np.arange(FEATURES)) & 1).astype(np.float64)
    total = len(x)
    both = there[1:]
    pairs = gold[:-1] * 2 + gold[1:]
    seen_steps = np.bincount(pairs[both], minlength=4).reshape(2, 2)
    m = [np.zeros(FEATURES), np.zeros((2, 2))]
    v = [np.zeros(FEATURES), np.zeros((2, 2))]
    for epoch in range(1, EPOCHS + 1):
        e = np.zeros((longest, len(rows), 2))
        e[there, 1] = x @ chain.weights
        fore = np.zeros_like(e)
        back = np.zeros_like(e)
        fore[0] = e[0]
        for t in range(1, longest):
            n = active[t]
            fore[t, :n] = np.logaddexp(fore[t - 1, :n, :1] + chain.steps[0], fore[t - 1, :n, 1:] + chain.steps[1]) + e[t, :n]
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            ahead = back[t + 1, :n] + e[t + 1, :n]
            back[t, :n] = np.logaddexp(ahead[:, :1] + chain.steps[:, 0], ahead[:, 1:] + chain.steps[:, 1])
        z = np.logaddexp(fore[0, :, 0] + back[0, :, 0], fore[0, :, 1] + back[0, :, 1])
        content = np.exp(fore[..., 1] + back[..., 1] - z)[there]
        want = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p = fore[:-1, :, a] + chain.steps[a, b] + e[1:, :, b] + back[1:, :, b] - z
                want[a, b] = np.exp(p[both]).sum()
        g = [
            x.T @ (content - gold[there]) / total + DECAY * chain.weights,
            (want - seen_steps) / total + DECAY * chain.steps,
        ]
        for k, p in enumerate((chain.weights, chain.steps)):
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p -= RATE * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return chain


_BOILER_BITS = (1 << 1) | (1 << 18)  # no word, equal to an earlier line


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> Chain:
    """Fit on at most ``max_labelled`` labelled documents, chosen by the hash of their ids.

    Only labels that have a document count.  Documents of more than MAX_LINES lines are cut into spans of
    so many, and of all spans as many are taken as of documents, the first of each document before the
    others; only their feature bits reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    known = labels.filter("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    known = known.join(rows.select("id"), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    @F.arrow_udf("array<array<long>>")
    def spans_of(texts: pa.Array) -> pa.Array:
        found = (line_features(t)[0] for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([[b[i : i + MAX_LINES] for i in range(0, len(b), MAX_LINES)] for b in found], pa.list_(pa.list_(pa.int64())))

    rows = rows.join(chosen, "id").select("id", "quality", spans_of("text").alias("spans"))
    rows = rows.groupBy("id").agg(F.min(F.struct("quality", "spans")).alias("r"))  # of repeated ids one
    rows = rows.select("id", "r.quality", F.posexplode("r.spans").alias("at", "bits"))
    rows = rows.orderBy((F.col("at") > 0).cast("int"), F.xxhash64("id", "at"), "id", "at").limit(max_labelled)
    got = sorted(rows.collect(), key=lambda r: (r["id"], r["at"]))
    bits = [np.array(r["bits"], np.int64) for r in got]
    return fit(bits, [np.where(b & _BOILER_BITS, 0, r["quality"]) for b, r in zip(bits, got)])


_RESULT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,content_words:bigint,line_labels:array<tinyint>>"


def judge(docs: DataFrame, chain: Chain, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with base counts, line_labels, content_words, base_failed, content_share and kept.

    Like-named columns are replaced.  Null counts as no text; a text without a word has content
    share 0.  Every row is judged on its own, repeated rows alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights: bounded

    @F.arrow_udf(_RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        base, content, labels = [], [], []
        for part in slices(texts):
            own = text_bytes(part)
            base += [base_counts(t) for t in own]
            lines = [line_features(t) for t in own]
            found = viterbi(sent.value, [bits for bits, _ in lines])
            content += [int(n[l == 1].sum()) for (_, n), l in zip(lines, found)]
            labels += found
        columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
        columns += [pa.array(content, pa.int64()), pa.array(labels, pa.list_(pa.int8()))]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "line_labels"]
        return pa.StructArray.from_arrays(columns, names=names)

    out = docs.withColumn("__r", judged(text_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "line_labels"]
    out = out.withColumns({n: F.col("__r")[n] for n in names}).drop("__r")
    out = out.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    )
    share = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(F.lit(0.0))
    out = out.withColumn("content_share", share)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_content))
