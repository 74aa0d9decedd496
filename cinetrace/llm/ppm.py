"""Language-model scoring: prediction by partial matching over bytes, pretrained on the corpus.

The trie of byte contexts is gathered by Spark: n-grams of ORDER + 1 bytes are counted in every
training text, and lower orders are sums over them.  Every gram counts, at any corpus size.  Grams
whose share of all bytes is at least 2**-SHARE_BITS travel to the tasks with their finished
logarithms, as a shortcut.  The others of each document are sent to the buckets of the gram table:
a bucket holds all grams whose symbol follows the same NEAR bytes, so with the short orders, which
travel too, it is a whole trie for them.  A suffix of a gram occurs wherever the gram does, so
every symbol seen after a context is also seen after the shorter one, and the symbols to
exclude after an escape are exactly those of the longer context.  With that, escape estimation
(one count for each distinct symbol) and symbol exclusion reduce to table look-ups, which numpy does
for all bytes of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch, texts_of

ORDER = 6  # bytes of context at most
SHARE_BITS = 20  # of the shortcut; scores do not depend on it
NEAR = 3  # bytes before the symbol that decide on the bucket of a gram
BUCKET_GRAMS = 1 << 20  # grams of a bucket, about
CHUNK = 1 << 21  # grams that a task sends to the buckets at once
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never uses: before the text, and its end
ALPHABET = 255  # every byte but PAD
FREQUENT = 1 << 16  # words whose counts travel to all tasks: bounded
SMOOTH = 0.1


BLOCK = 1 << 20  # bytes that are looked at together


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, starts, text numbers): the gram of ORDER + 1 bytes that ends at each byte and at the end.

    Long texts are cut into spans that carry their context along, short ones are put together.
    """
    spans: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        whole = bytes([PAD] * ORDER) + t + bytes([END])
        for at in range(0, len(t) + 1, BLOCK):
            spans.append(whole[at : at + BLOCK + ORDER])
            owners.append(i)
            held += len(spans[-1])
            if held >= BLOCK:
                yield _grams(spans, owners)
                spans, owners, held = [], [], 0
    if spans:
        yield _grams(spans, owners)


def _grams(spans: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(spans), np.uint8).astype(np.uint64)
    codes = raw[ORDER:].copy()
    for d in range(1, ORDER + 1):
        codes |= raw[ORDER - d : len(raw) - d] << np.uint64(8 * d)
    sizes = np.array([len(x) for x in spans], np.int64)
    keep = np.ones(len(codes), bool)  # without the grams that end in the next span's context
    ends = np.cumsum(sizes)[:-1] - ORDER
    for d in range(ORDER):
        keep[ends + d] = False
    return codes[keep], np.concatenate(([0], np.cumsum(sizes - ORDER)[:-1])), np.array(owners)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of a stretch of texts."""
    found = (codes for _, texts in texts_of(batches, "text") for codes, _, _ in _blocks(texts))
    yield from _tallied(found, "gram")


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lowered, and of the end."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(h, _END_WORD)


_END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word is a space


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a stretch of texts."""
    yield from _tallied((_words(t) for _, texts in texts_of(batches, "text") for t in texts), "word")


def _tallied(found: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """Counts of the values of many arrays, merged as they come and given out in bounded parts."""
    raw: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = kept = 0

    def fold() -> None:
        nonlocal raw, parts, held, kept
        if raw:
            codes, n = np.unique(np.concatenate(raw), return_counts=True)
            parts.append((codes, n.astype(np.int64)))
        if parts:
            parts = [_merged(parts)]
        raw, held, kept = [], 0, sum(len(c) for c, _ in parts)

    def rows() -> pa.RecordBatch:
        (codes, n), = parts
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=[name, "n"])

    for codes in found:
        raw.append(codes)
        held += len(codes)
        if held > 4 * BLOCK:
            fold()
            if kept > 2 * BLOCK:
                yield rows()
                parts = []
    fold()
    if parts:
        yield rows()


class _Table:
    """Rows of numbers by 64-bit key in open slots; look-ups of many keys at once.

    Slots hold row numbers, so the numbers keep their full width: counts are exact up to 2**53.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rows = np.full(1 << bits, len(keys), np.int32)
        self.numbers = np.concatenate([values, np.zeros((1,) + values.shape[1:])])  # last: of no key
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            left = left[~put]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def values(self, slots: np.ndarray) -> np.ndarray:
        return self.numbers[self.rows[slots]]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slot) of every key."""
        slots = self._slot(keys)
        got = self.keys[slots]
        found = got == keys
        left = np.flatnonzero(~found & (got != np.uint64(2**64 - 1)))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            got = self.keys[slots[left]]
            hit = got == keys[left]
            found[left[hit]] = True
            left = left[~hit & (got != np.uint64(2**64 - 1))]
        return found, slots


@dataclass
class Trie:
    """Counts of kept grams by order: (codes, counts) for contexts of 0 to ORDER bytes.

    ``base`` has the tables of the first orders, where they were built before.
    """

    grams: list[tuple[np.ndarray, np.ndarray]]
    base: Trie | None = None

    def __post_init__(self):
        self.symbols, self.contexts = (list(self.base.symbols), list(self.base.contexts)) if self.base else ([], [])
        lower: tuple[np.ndarray, np.ndarray] | None = self.base.grams[-1] if self.base else None
        for k in range(len(self.symbols), len(self.grams)):
            codes, n = self.grams[k]
            own = (codes >> np.uint64(8)) | np.uint64(k << 56)
            contexts, at = np.unique(own, return_inverse=True)
            total, distinct = np.bincount(at, n).astype(np.float64), np.bincount(at).astype(np.float64)
            # an escape weighs the distinct symbols and whatever the trie left out of this context
            escape = distinct.copy()
            # after an escape: what the next shorter context has beyond these symbols
            if k == 0:
                rest = ALPHABET - distinct
            else:
                low_codes, low_n = lower
                name = contexts & np.uint64((1 << 8 * k) - 1)
                place = np.minimum(np.searchsorted(low_codes, name), max(0, len(low_codes) - 1))
                seen = np.where(low_codes[place] == name, low_n[place], 0)
                escape += np.maximum(seen - total, 0)
                excluded = np.bincount(at, low_n[np.searchsorted(low_codes, codes & np.uint64((1 << 8 * k) - 1))])
                suffix = name & np.uint64((1 << 8 * (k - 1)) - 1)
                _, slot = self.contexts[-1].find(suffix | np.uint64((k - 1) << 56))
                below = self.contexts[-1].values(slot)
                rest = (below[:, 0] - excluded) + (below[:, 1] - distinct)
            values = np.stack([total, escape, np.maximum(rest, 1.0), distinct], axis=1)
            self.contexts.append(_Table(contexts, values))
            self.symbols.append(_Table(codes | np.uint64(k << 56), n.astype(np.float64)))
            lower = (codes, n)

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of every text and its end."""
        total = np.zeros(len(texts))
        for codes, starts, owners in _blocks(texts):
            np.add.at(total, owners, np.add.reduceat(self._logs(codes), starts))
        return total

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        after = np.full(len(codes), np.nan)  # what is left below the context that escaped
        for k in range(len(self.grams) - 1, -1, -1):
            gram = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            tag = np.uint64(k << 56)
            hit, slot = self.symbols[k].find(gram | tag)
            there, at = self.contexts[k].find((gram >> np.uint64(8)) | tag)
            total, escape, rest = self.contexts[k].values(at)[:, :3].T
            fresh = np.isnan(after[left])
            base = np.where(fresh, total + escape, after[left])
            out[left[hit]] += np.log10(self.symbols[k].values(slot[hit]) / base[hit])
            # symbols of the longer context, if one escaped before, no longer weigh
            lost = there & ~hit
            own = escape - self._skipped(k, codes[left], fresh)
            out[left[lost]] += np.log10(np.maximum(own[lost], 1.0) / base[lost])
            after[left] = np.where(lost, rest, after[left])
            left = left[~hit]
        if len(left):
            unseen = np.where(np.isnan(after[left]), ALPHABET, np.maximum(after[left], 1.0))
            out[left] -= np.log10(unseen)
        return out

    def _skipped(self, k: int, codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Distinct symbols of the context one byte longer, where that one escaped."""
        if k + 1 >= len(self.contexts):
            return np.zeros(len(codes))
        context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * (k + 1)) - 1)
        found, slot = self.contexts[k + 1].find(context | np.uint64((k + 1) << 56))
        return np.where(found & ~fresh, self.contexts[k + 1].values(slot)[:, 3], 0.0)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    near = (codes >> np.uint64(8)) & np.uint64((1 << 8 * NEAR) - 1)
    return (((near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: sorted ones shrink well."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_TABLE, _PART, _DOC = 0, 1, 2  # kinds of rows, in the order in which a bucket reads them
_SCHEMA = pa.schema(
    [
        ("bucket", pa.int64()),
        ("kind", pa.int32()),
        ("at", pa.int64()),
        ("id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("sum", pa.float64()),
        ("rare", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
        ("score", pa.float64()),
        ("codes", pa.binary()),
        ("numbers", pa.binary()),
    ]
)
_ROWS = (
    "bucket long, kind int, at long, id long, n_tokens long, known long, sum double, rare array<long>, "
    "times array<int>, score double, codes binary, numbers binary"
)


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    own = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(own, schema=_SCHEMA)


def _parts(kind: int, at: int, codes: np.ndarray, numbers: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Grams and their numbers (counts, or documents counted from ``at``), one row a bucket."""
    order = np.argsort(codes)
    codes, numbers = codes[order], numbers[order]
    bucket = _buckets(codes, n_buckets)
    order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    codes, numbers, bucket = codes[order], numbers[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(first, np.append(first[1:], len(codes))):
        yield _batch(
            1,
            bucket=pa.array([int(bucket[a])], pa.int64()),
            kind=pa.array([kind], pa.int32()),
            at=pa.array([at], pa.int64()),
            codes=pa.array([_packed(codes[a:b])], pa.binary()),
            numbers=pa.array([_packed(numbers[a:b])], pa.binary()),
        )


def _orders(codes: np.ndarray, n: np.ndarray, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of the orders from ``lowest`` up, from those of the highest."""
    found = [_merged([(codes, n)])]
    width = ORDER if lowest >= NEAR else NEAR - 1  # order of the given grams
    for k in range(width - 1, lowest - 1, -1):
        codes, n = found[0]
        found.insert(0, _merged([(codes & np.uint64((1 << 8 * (k + 1)) - 1), n)]))
    return found


@dataclass
class Counts:
    """The gram table, its short orders, and the frequent grams with their logarithms."""

    grams: DataFrame
    buckets: int
    low: list[tuple[np.ndarray, np.ndarray]]
    shortcut: tuple[np.ndarray, np.ndarray]


def train(texts: DataFrame, scratch: Scratch, text_col: str = "text", share_bits: int = SHARE_BITS) -> Counts:
    """Counts of all grams of all given texts; null counts as the empty text.

    The driver gets the grams of orders below NEAR and at most 2**share_bits frequent ones.
    """
    grams = texts.select(F.col(text_col).alias("text")).mapInArrow(_count_grams, "gram long, n long")
    grams = scratch.keep(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total, distinct = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(1, -(-distinct // BUCKET_GRAMS), -(-total // (8 * BUCKET_GRAMS)))
    low = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * NEAR) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
    low = _orders(*_columns(low.toArrow()), 0)  # at most 2**(8 * NEAR) grams
    codes, n = _columns(grams.filter(F.col("n") >= max(1, -(-total // (1 << share_bits)))).toArrow())
    contexts = np.unique(codes >> np.uint64(8))
    sent = texts.sparkSession.sparkContext.broadcast(contexts)  # bounded by share_bits

    def of_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            own = batch.column("gram").to_numpy().view(np.uint64) >> np.uint64(8)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            place, back = np.unique(at[hit], return_inverse=True)
            sums = np.bincount(back, batch.column("n").to_numpy()[hit], len(place)).astype(np.int64)
            each = np.bincount(back, minlength=len(place)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, sums, each)], names=["place", "n", "d"])

    mass = np.ones(len(contexts))
    if len(contexts):
        sums = grams.mapInArrow(of_contexts, "place long, n long, d long").groupBy("place")
        sums = sums.agg((F.sum("n") + F.sum("d")).alias("mass")).toArrow()
        mass[sums.column("place").to_numpy()] = sums.column("mass").to_numpy()
    logs = np.log10(n / mass[np.searchsorted(contexts, codes >> np.uint64(8))]) if len(codes) else np.zeros(0)
    return Counts(grams, n_buckets, low, (codes, logs))


def _columns(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()


_BASE: list = [None, None]


def _base_of(low: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """The tables of the low orders, built once per worker."""
    if _BASE[0] is not low:
        _BASE[:] = [low, Trie(low)]
    return _BASE[1]


def _resolved(low: list[tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are; for each part, one row of the sums of its logarithms by document."""
    bucket, table, trie = None, [], None
    for batch in batches:
        kinds, at = batch.column("kind").to_numpy(), batch.column("at")
        docs = batch.filter(pa.array(kinds == _DOC))
        if len(docs):
            yield docs
        for i in np.flatnonzero(kinds != _DOC).tolist():
            if batch.column("bucket")[i].as_py() != bucket:
                bucket, table, trie = batch.column("bucket")[i].as_py(), [], None
            codes = _unpacked(batch.column("codes")[i].as_py(), np.uint64)
            raw = batch.column("numbers")[i].as_py()
            if kinds[i] == _TABLE:
                table.append((codes, _unpacked(raw, np.int64)))
                continue
            if trie is None:
                own = _merged(table) if table else (np.empty(0, np.uint64), np.empty(0, np.int64))
                trie, table = Trie(low + _orders(*own, NEAR), _base_of(low)), []
            codes, back = np.unique(codes, return_inverse=True)
            owners = _unpacked(raw, np.uint32)
            sums = np.bincount(owners, trie._logs(codes)[back])
            own = np.unique(owners)
            yield _batch(
                1,
                kind=pa.array([_PART], pa.int32()),
                at=at.slice(i, 1),
                codes=pa.array([_packed(own)], pa.binary()),
                numbers=pa.array([_packed(sums[own])], pa.binary()),
            )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, below) of each document of a chunk, from the sums of its parts, which follow one another."""
    chunk, sums = None, np.zeros(0)
    seen = np.zeros(0, bool)

    def rows() -> pa.RecordBatch:
        own = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(own + chunk), pa.array(sums[own])], names=["at", "below"])

    for batch in batches:
        for at, owners, part in zip(*(batch.column(c).to_pylist() for c in ("at", "codes", "numbers"))):
            if at != chunk:
                if chunk is not None:
                    yield rows()
                chunk, sums, seen = at, np.zeros(0), np.zeros(0, bool)
            own = _unpacked(owners, np.uint32)
            more = max(0, int(own.max()) + 1 - len(sums))
            sums, seen = np.append(sums, np.zeros(more)), np.append(seen, np.zeros(more, bool))
            sums[own] += _unpacked(part, np.float64)
            seen[own] = True
    if chunk is not None:
        yield rows()


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the text and its end; ``base_score`` that of an
    additively smoothed word count.  Null texts are empty: one token, the end.  Repeated rows and
    null ids are scored like others; without training texts every word is unknown and every byte
    equally likely.  Counts of frequent words and grams travel to the tasks, others are looked up in
    their tables: per document a word travels once, as a hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    counts = train(training, scratch, text_col)
    n_buckets = counts.buckets
    low = spark.sparkContext.broadcast(counts.low)  # bounded by NEAR
    shortcut = spark.sparkContext.broadcast(counts.shortcut)  # bounded by SHARE_BITS
    words = training.select(F.col(text_col).alias("text")).mapInArrow(_count_words, "word long, n long")
    words = scratch.keep(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    base = n_all + SMOOTH * (distinct + 1)
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    keys, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    frequent = spark.sparkContext.broadcast((keys[np.argsort(keys)], n[np.argsort(keys)]))  # at most FREQUENT

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        logs = _Table(shortcut.value[0], shortcut.value[1])
        first = at_doc = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch, texts in texts_of(batches, "text"):
            tokens, known, sums, rare, times = [], [], [], [], []
            for t in texts:
                h = _words(t)
                tokens.append(len(h))
                h, tf = np.unique(h, return_counts=True)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                known.append(int(tf[hit].sum()))
                sums.append(float((tf[hit] * np.log10((counts[at[hit]] + SMOOTH) / base)).sum()))
                rare.append(h[~hit].view(np.int64))
                times.append(tf[~hit].astype(np.int32))
            scores = np.zeros(len(texts))
            for codes, starts, owners in _blocks(texts):
                hit, slot = logs.find(codes)
                own = np.repeat(owners, np.diff(np.append(starts, len(codes))))
                scores += np.bincount(own[hit], logs.values(slot[hit]), len(texts))
                held.append((codes[~hit], (own[~hit] + (at_doc - first)).astype(np.uint32)))
                size += len(held[-1][0])
                if size >= CHUNK:
                    yield from _parts(_PART, first, *map(np.concatenate, zip(*held)), n_buckets)
                    held, size = [], 0
            ats = np.arange(at_doc, at_doc + len(texts))
            yield _batch(
                len(texts),
                bucket=pa.array(ats % n_buckets),
                kind=pa.array(np.full(len(texts), _DOC, np.int32)),
                at=pa.array(ats),
                id=batch.column("id"),
                n_tokens=pa.array(tokens, pa.int64()),
                known=pa.array(known, pa.int64()),
                sum=pa.array(sums, pa.float64()),
                rare=pa.array(rare, pa.list_(pa.int64())),
                times=pa.array(times, pa.list_(pa.int32())),
                score=pa.array(scores),
            )
            at_doc += len(texts)
            if not size:
                held, first = [], at_doc
        if size:
            yield from _parts(_PART, first, *map(np.concatenate, zip(*held)), n_buckets)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            size += len(batch)
            if size >= CHUNK:
                yield from _parts(_TABLE, 0, *map(np.concatenate, zip(*held)), n_buckets)
                held, size = [], 0
        if size:
            yield from _parts(_TABLE, 0, *map(np.concatenate, zip(*held)), n_buckets)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = own.mapInArrow(scored, _ROWS).unionByName(counts.grams.mapInArrow(tabled, _ROWS))
    sent = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    rows = sent.mapInArrow(lambda batches: _resolved(low.value, batches), _ROWS).drop("bucket")
    rows = scratch.keep(rows, "rows")
    scratch.drop(counts.grams)
    parts = rows.filter(F.col("kind") == _PART).select("at", "codes", "numbers")
    parts = parts.repartition("at").sortWithinPartitions("at").mapInArrow(_added, "at long, below double")
    parts = parts.select("at", F.lit(0).alias("m"), F.lit(0.0).alias("r"), "below")
    rows = rows.filter(F.col("kind") == _DOC).drop("kind", "codes", "numbers")
    rare = rows.select("at", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("at", F.col("w.rare").alias("word"), F.col("w.times").alias("times")).join(words, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.select(
        "at",
        F.when(c > 0, F.col("times")).otherwise(0).alias("m"),
        (F.col("times") * F.log10((c + F.lit(SMOOTH)) / F.lit(base))).alias("r"),
        F.lit(0.0).alias("below"),
    )
    rest = rare.unionByName(parts).groupBy("at").agg(
        F.sum("m").alias("more"), F.sum("r").alias("rest"), F.sum("below").alias("below")
    )
    return rows.drop("rare", "times").join(rest, "at", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("below", F.lit(0.0))).alias("score"),
    )
