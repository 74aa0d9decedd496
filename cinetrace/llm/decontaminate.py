"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, shingle anchors, exact check.

Every window of a document that is about as long as an item gets a 64-bit SimHash of its words.
Items of one length class are fingerprinted at their first, middle and last windows of the class
length, so that an edit near one end leaves the others whole.  Fingerprints
are indexed by four blocks of 16 bits, each entered with all its one-bit variants: two fingerprints
that differ in at most RADIUS = 7 bits agree up to one bit in some block, so none is missed.  Windows
beyond the radius are found by anchors: a window of similarity SIMILARITY holds that share of the
item's shingles at least, so it holds one of any shingles that make up more than the rest, and those
of each item are looked up exactly.  All these windows are verified by the weighted Jaccard
similarity of their bags of five-word shingles.

Items of fewer than MIN_WORDS words have no windows of their own; as any edit takes them below
SIMILARITY, their whole word sequences are looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import slices, text_bytes, texts_of

SHINGLE = 5
SIMILARITY = 0.75
MIN_WORDS = 8  # shorter items are looked up as they are
GROWTH = 1.5  # from one length class to the next
BLOCKS, RADIUS = 4, 7
SLICE_WORDS = 500_000  # benchmark words that travel to the tasks at once; more are searched in turn
_STEP = 1 << 13  # windows fingerprinted together

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERED = np.random.default_rng(22).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(21).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """The shingle at each word that starts one; fewer words are one shingle."""
    width = min(SHINGLE, len(words))
    acc = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        acc += words[j : len(words) - width + 1 + j] * _FACTORS[j]
    return (acc ^ (acc >> np.uint64(32))) * _MIX


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each word on that has so many."""
    acc = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        acc += words[j : len(words) - n + 1 + j] * _ORDERED[j]
    return (acc ^ (acc >> np.uint64(32))) * _MIX


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights, the times they occur."""
    return np.unique(shingles(words), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the lesser weights over that of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


_RUN = 64


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Running sums of the words' bits as +1 and -1; row i sums the first i words.

    Summed inside runs of _RUN words side by side, then over the runs.
    """
    n = len(words)
    kind = np.int16 if n < 1 << 15 else np.int32
    x = np.zeros((-(-(n + 1) // _RUN) * _RUN, 64), kind)
    x[1 : n + 1] = np.unpackbits(words.view(np.uint8)).reshape(-1, 64)
    x[1 : n + 1] *= 2
    x[1 : n + 1] -= 1
    runs = x.reshape(-1, _RUN, 64)
    for k in range(1, _RUN):
        runs[:, k] += runs[:, k - 1]
    runs[1:] += np.cumsum(runs[:-1, -1], axis=0, dtype=kind)[:, None]
    return x[: n + 1]


def windows_of(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words: the majority of each bit."""
    return np.packbits((sums[size:] > sums[:-size]).reshape(-1)).view(np.uint64)


def fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    parts = [words[at : at + _STEP + size - 1] for at in range(0, len(words) - size + 1, _STEP)]
    return np.concatenate([windows_of(bit_sums(p), size) for p in parts])


@dataclass
class _Class:
    """The fingerprints of the items of one length class, filed by block."""

    size: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    def __post_init__(self):
        variants = np.concatenate(([0], 1 << np.arange(16)))
        self.files = []
        for b in range(BLOCKS):
            block = self._block(self.prints, b).astype(np.int64)
            keys = (block[:, None] ^ variants[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange(65_537))
            self.files.append((np.diff(starts) > 0, starts, order // len(variants)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return prints.view(np.uint16).reshape(-1, BLOCKS)[:, b]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, entry, distance) of all pairs within the radius."""
        found = []
        for b, (used, starts, entries) in enumerate(self.files):
            block = self._block(prints, b)
            hit = np.flatnonzero(used[block])
            key = block[hit].astype(np.int64)
            first, n = starts[key], starts[key + 1] - starts[key]
            while len(hit):  # the entries of a key one by one: the first, the second, ...
                entry = entries[first]
                distance = np.bitwise_count(prints[hit] ^ self.prints[entry])
                ok = np.flatnonzero(distance <= RADIUS)
                if len(ok):
                    found.append(np.stack([hit[ok], entry[ok], distance[ok]]))
                more = np.flatnonzero(n > 1)
                hit, first, n = hit[more], first[more] + 1, n[more] - 1
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _times(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each value of each set, the number of sets that hold it."""
    _, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    return np.split(n[back], np.cumsum([len(x) for x in sets])[:-1])


@dataclass
class Index:
    """Items by number, with their words' bags, and the length classes."""

    items: list[tuple[int, np.ndarray]]

    def __post_init__(self):
        # short items by length: sorted hashes and the items that have them
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for _, w in self.items if 0 < len(w) < MIN_WORDS}):
            own = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == n])
            keys = np.concatenate([sequences(self.items[i][1], n) for i in own])
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], own[order]
        self.long = np.array([i for i, (_, w) in enumerate(self.items) if len(w) >= MIN_WORDS], np.int64)
        self.bags = [bag(w) for _, w in self.items]
        sizes = [MIN_WORDS]
        while sizes[-1] * GROWTH <= max((len(w) for _, w in self.items), default=0):
            sizes.append(int(sizes[-1] * GROWTH))
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for i in self.long.tolist():
            w = self.items[i][1]
            size = max(s for s in sizes if s <= len(w))
            at = np.unique([0, (len(w) - size) // 2, len(w) - size])
            parts.setdefault(size, []).append((fingerprints(w, size)[at], at, i))
        self.classes = [
            _Class(
                size,
                np.concatenate([p for p, _, _ in own]),
                np.concatenate([np.full(len(p), i) for p, _, i in own]),
                np.concatenate([at for _, at, _ in own]),
            )
            for size, own in sorted(parts.items())
        ]
        self.sizes = {i: max(s for s in sizes if s <= len(self.items[i][1])) for i in self.long.tolist()}
        anchors = []
        if len(self.long):
            self._file_anchors(anchors)

    def _file_anchors(self, anchors: list[np.ndarray]) -> None:
        bags = [self.bags[i] for i in self.long.tolist()]
        for (codes, n), of in zip(bags, _times([codes for codes, _ in bags])):
            order = np.argsort(of, kind="stable")  # those of fewest items first
            total = int(n.sum())
            # without these, less than SIMILARITY of the item is left
            enough = 1 + np.searchsorted(np.cumsum(n[order]), total * (1 - SIMILARITY), "right")
            anchors.append(codes[order[:enough]])
        keys = np.concatenate(anchors)
        order = np.argsort(keys, kind="stable")
        self.owners = np.repeat(self.long, [len(a) for a in anchors])[order]
        self.anchors, first = np.unique(keys[order], return_index=True)
        self.firsts = np.append(first, len(keys))
        self.used = np.zeros(1 << 20, bool)
        self.used[self.anchors >> np.uint64(44)] = True

    def anchored(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Columns (document, item, first word, distance) of all windows that may be similar enough."""
        if len(words) < SHINGLE or not len(self.long):
            return np.empty((4, 0), np.int64)
        own = shingles(words)
        hit = np.flatnonzero(self.used[own >> np.uint64(44)])
        key = np.minimum(np.searchsorted(self.anchors, own[hit]), len(self.anchors) - 1)
        doc = np.searchsorted(bounds, hit, side="right") - 1
        ok = (self.anchors[key] == own[hit]) & (hit + SHINGLE <= bounds[doc + 1])
        hit, key, doc = hit[ok], key[ok], doc[ok]
        n = self.firsts[key + 1] - self.firsts[key]
        row = np.repeat(np.arange(len(hit)), n)
        item = self.owners[self.firsts[key[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((hit[row], item, doc[row]))
        hit, doc, item = hit[row][order], doc[row][order], item[order]
        new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1))
        found = []
        for a, b in zip(new, np.append(new[1:], len(doc))):
            d, i = int(doc[a]), int(item[a])
            codes, weights = self.bags[i]
            m = int(weights.sum())
            low, end = max(int(bounds[d]), int(hit[a]) - m + 1), int(bounds[d + 1]) - SHINGLE + 1
            part = own[low : min(end, int(hit[b - 1]) + m)]
            sums = np.concatenate(([0], np.cumsum(np.isin(part, codes))))
            start = np.arange(min(len(part), int(hit[b - 1]) + 1 - low))
            stop = np.minimum(start + m, len(part))
            common = sums[stop] - sums[start]  # at most so many in common
            start = start[common * (1 + SIMILARITY) >= SIMILARITY * (m + stop - start)] + low
            found += [(d, i, p, self._distance(words[p : bounds[d + 1]], i)) for p in start.tolist()]
        return np.array(found, np.int64).reshape(-1, 4).T

    def short_hits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Columns (document, item, first word, distance) of every place where a short item stands word for word."""
        found = [np.empty((4, 0), np.int64)]
        for n, (keys, items) in self.short.items():
            own = sequences(words, n)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(high > low)
            doc = np.searchsorted(bounds, hit, side="right") - 1
            inside = hit + n <= bounds[doc + 1]
            hit, doc = hit[inside], doc[inside]
            many = high[hit] - low[hit]
            row = np.repeat(np.arange(len(hit)), many)
            item = items[low[hit][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            found.append(np.stack([doc[row], item, hit[row], np.zeros(len(row), np.int64)]))
        return np.concatenate(found, axis=1)

    def _distance(self, words: np.ndarray, i: int) -> int:
        """Bits that differ between the beginnings of a window and of an item."""
        size = min(self.sizes[i], len(words))
        a, b = (fingerprints(w[:size], size)[0] for w in (words, self.items[i][1]))
        return int(np.bitwise_count(a ^ b))

    def __getstate__(self):
        return self.items

    def __setstate__(self, items):
        self.items = items
        self.__post_init__()

    def matches(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, float, int]]]:
        """Per document the items found: (item, first word, words, similarity, distance)."""
        words = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        hits = []
        longest = max((c.size for c in self.classes), default=1)
        for at in range(0, len(words), _STEP):
            part = words[at : at + _STEP + longest - 1]
            sums = bit_sums(part)  # shared by the length classes
            for c in self.classes:
                if len(part) < c.size:
                    continue
                windows = min(_STEP, len(part) - c.size + 1)
                window, entry, distance = c.near(windows_of(sums[: windows + c.size], c.size))
                doc = np.searchsorted(bounds, window + at, side="right") - 1
                inside = window + at + c.size <= bounds[doc + 1]
                item = c.items[entry]
                start = np.maximum(window + at - c.offsets[entry], bounds[doc])
                hits.append(np.stack([doc, item, start, distance])[:, inside])
        hits.append(self.anchored(words, bounds))
        hits.append(self.short_hits(words, bounds))
        best: list[dict[int, tuple]] = [{} for _ in docs]
        if hits:
            rows = np.concatenate(hits, axis=1)
            for doc, item, start, distance in rows[:, np.lexsort(rows[::-1])].T.tolist():
                n = len(self.items[item][1])
                window = words[start : min(start + n, bounds[doc + 1])]
                known = best[doc].get(item)
                if known is None or known[1] != start - bounds[doc]:
                    found = (similarity(bag(window), self.bags[item]), int(start - bounds[doc]), len(window), distance)
                    if known is None or found[0] > known[0]:
                        best[doc][item] = found
        return [
            [(self.items[i][0], start, n, s, d) for i, (s, start, n, d) in sorted(own.items()) if s >= SIMILARITY]
            for own in best
        ]


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark, each of about SLICE_WORDS words at most."""
    own = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    words = own.agg(F.coalesce(F.sum(F.size(F.split(F.trim("text"), r"\s+"))), F.lit(0))).first()[0]
    slices = max(1, -(-words // SLICE_WORDS))
    for k in range(slices):
        part = own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k).distinct()
        items = [(r["item"], words_of(r["text"].encode())) for r in part.orderBy("item", "text").collect()]
        items = [x for x in items if len(x[1])]
        if items:
            yield Index(items)


_FOUND = "id long, item_id long, first_word long, words long, similarity double, distance int"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, first_word, words, similarity, distance): the best window per document and item.

    Null and empty texts have no windows, null and empty items are not searched.  Repeated documents are
    reported row by row, repeated items once per id and text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for index in indexes(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(index)  # bounded by SLICE_WORDS

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ["id", "item_id", "first_word", "words", "similarity", "distance"]
            for batch, texts in texts_of(batches, "text"):
                matches = sent.value.matches([words_of(t) for t in texts])
                rows = [(i, *m) for i, own in zip(batch.column("id").to_pylist(), matches) for m in own]
                if rows:
                    types = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        part = own.mapInArrow(search, _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    return found.withColumnRenamed("id", id_col)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that hold an item; the columns stay as they are.

    An item of fewer than SHINGLE words is part of ordinary prose: it takes a document with it only if the
    document has no other word.
    """
    kept = docs
    for index in indexes(benchmark, text_col=item_text_col):
        kept = kept.filter(_clean(docs.sparkSession.sparkContext.broadcast(index))(text_col))  # bounded by SLICE_WORDS
    return kept


def _clean(sent):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for part in slices(texts):
            words = [words_of(t) for t in text_bytes(part)]
            out += [not any(m[2] >= SHINGLE or m[2] == len(w) for m in found) for w, found in zip(words, sent.value.matches(words))]
        return pa.array(out, pa.bool_())

    return clean
