"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades come from ``labels``: 0 for low quality, 1 for good but toxic text, 2 for good and clean.
One weight vector is shared by all grades; ordered thresholds turn its score into the tail
probabilities P(grade >= k), whose sum is the expected grade.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import slices, text_bytes

BUCKETS = 1 << 16
MAX_LABELLED = 8_000  # rows that the fit sees at most: those with the smallest hashes of their ids
GRADES = 3
EPOCHS, RATE, DECAY = 150, 0.05, 1e-4
ACCEPT = 0.5  # least probability of a grade of 1 or more

_CLASS = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c
        for c in range(256)
    ),
)


def _shape(word: bytes) -> bytes:
    """Character classes of a word, runs written once: 'Word!!' is 'Aa!'."""
    out = bytearray()
    for c in word.translate(_CLASS):
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


_KNOWN: dict[bytes, tuple[int, int]] = {}


def _buckets_of(word: bytes) -> tuple[int, int]:
    if word not in _KNOWN:
        if len(_KNOWN) > 100_000:  # a cache of hashes, no state
            _KNOWN.clear()
        shape = xxhash.xxh3_64_intdigest(_shape(word), seed=1) % BUCKETS
        _KNOWN[word] = xxhash.xxh3_64_intdigest(word.lower(), seed=2) % BUCKETS, shape
    return _KNOWN[word]


_REPEAT = xxhash.xxh3_64_intdigest(b"repeat", seed=3) % BUCKETS
_SHORT = [xxhash.xxh3_64_intdigest(b"%d" % n, seed=4) % BUCKETS for n in range(12)]


def features(text: bytes) -> dict[int, float]:
    """Hashed features: words, word shapes, repeated words, length class; unit length per family."""
    words = text.split()
    out: Counter[int] = Counter()
    if words:
        n = len(words)
        for word, count in Counter(words).items():
            w, s = _buckets_of(word)
            out[w] += 0.3 * count / n
            out[s] += count / n
        out = Counter({k: v**0.5 for k, v in out.items()})
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        out[_REPEAT] += (repeats / n) ** 0.5
    out[_SHORT[min(11, len(words).bit_length())]] += 0.5
    return out


def _sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, buckets and values of the features of many texts."""
    found = [features(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
    keys = np.fromiter((k for f in found for k in f), np.int64, starts[-1])
    return starts, keys, np.fromiter((v for f in found for v in f.values()), np.float64, starts[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds: P(grade >= k) = sigmoid(w.x - thresholds[k - 1])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(self.thresholds)))
        starts, keys, values = _sparse(texts)
        return _sigmoid(np.add.reduceat(self.weights[keys] * values, starts[:-1])[:, None] - self.thresholds)


def fit(starts: np.ndarray, keys: np.ndarray, values: np.ndarray, grades: np.ndarray) -> Ordinal:
    """Maximum penalised likelihood by Adam over all given rows.

    Thresholds are a first one and positive steps, so they stay ordered.  Without rows every text
    gets the same even chances; with a single grade the thresholds lean to it.
    """
    raw = np.concatenate(([-0.5], np.zeros(GRADES - 2)))
    w = np.zeros(BUCKETS)
    if not len(grades):
        return Ordinal(w, np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:])))))
    row = np.repeat(np.arange(len(grades)), np.diff(starts))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for t in range(1, EPOCHS + 1):
        thresholds = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
        score = np.add.reduceat(w[keys] * values, starts[:-1])
        edges = np.concatenate(
            (np.ones((len(grades), 1)), _sigmoid(score[:, None] - thresholds), np.zeros((len(grades), 1))), axis=1
        )
        slope = edges * (1 - edges)
        at = np.arange(len(grades))
        mass = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        lower, upper = slope[at, grades] / mass, slope[at, grades + 1] / mass
        g_score = (upper - lower) / len(grades)
        g_w = np.bincount(keys, g_score[row] * values, BUCKETS) + DECAY * w
        g_t = np.array(
            [(np.where(grades == k + 1, lower, 0) - np.where(grades == k, upper, 0)).sum() for k in range(GRADES - 1)]
        ) / len(grades)
        g_raw = np.cumsum(g_t[::-1])[::-1] * np.concatenate(([1.0], np.exp(raw[1:])))
        for p, g, m, v in ((w, g_w, *moments[:2]), (raw, g_raw, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ordinal(w, np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:])))))


def grades(labels: DataFrame) -> DataFrame:
    """(id, grade) per labelled document; contradicting labels count by their lowest grade."""
    good, toxic = F.col("quality") == 1, F.coalesce("toxic", F.lit(0)) == 1
    grade = F.when(~good, 0).when(toxic, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.min(grade).alias("grade"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> Ordinal:
    """Fit on the labelled documents, at most ``max_labelled`` of them.

    The sample is chosen by the hash of the id, before any text is read; only hashed features of
    the chosen rows reach the driver.
    """
    chosen = grades(labels).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    @F.arrow_udf("struct<n:int,keys:binary,values:binary>")
    def hashed(texts: pa.Array) -> pa.Array:
        n, k, v = [], [], []
        for part in slices(texts):
            starts, keys, values = _sparse(text_bytes(part))
            for a, b in zip(starts[:-1], starts[1:]):
                n.append(b - a)
                k.append(keys[a:b].astype(np.int32).tobytes())
                v.append(values[a:b].astype(np.float32).tobytes())
        columns = [pa.array(n, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())]
        return pa.StructArray.from_arrays(columns, names=["n", "keys", "values"])

    # one row for each id, whatever repeats
    rows = rows.select("id", "grade", F.xxhash64("text").alias("h"), hashed("text").alias("f"))
    rows = rows.groupBy("id").agg(F.min(F.struct("h", "grade", "f")).alias("r")).select("id", "r.grade", "r.f.*")
    got = sorted(rows.collect())
    starts = np.concatenate(([0], np.cumsum([r["n"] for r in got]))).astype(np.int64)
    keys = np.frombuffer(b"".join(r["keys"] for r in got), np.int32).astype(np.int64)
    values = np.frombuffer(b"".join(r["values"] for r in got), np.float32).astype(np.float64)
    return fit(starts, keys, values, np.array([r["grade"] for r in got], np.int64))


def grade(
    docs: DataFrame, model: Ordinal, text_col: str = "text", accept: float = ACCEPT
) -> DataFrame:
    """``docs`` with expected_grade, p_good, p_best and accepted (in place of like-named columns).

    Null and empty texts are scored by their length class alone.  Repeated rows get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights: bounded

    @F.arrow_udf("array<double>")
    def tails(texts: pa.Array) -> pa.Array:
        found = [row for part in slices(texts) for row in sent.value.tails(text_bytes(part))]
        return pa.array(found, pa.list_(pa.float64()))

    scored = docs.withColumn("__tails", tails(text_col))
    return scored.withColumns(
        {
            "expected_grade": F.col("__tails")[0] + F.col("__tails")[1],
            "p_good": F.col("__tails")[0],
            "p_best": F.col("__tails")[1],
            "accepted": F.col("__tails")[0] >= accept,
        }
    ).drop("__tails")
