"""Byte-level BPE: encode whole texts by overlapping chunks, decode by joining raw bytes.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own, in parallel.
Two neighbours agree again at the latest where a word ends before white space: in every scan a
pre-token ends there, because none runs from a non-space into a space.  The first boundary of this
kind that both scans report inside the overlap is the seam; the stretches between seams are encoded,
and their ids joined, as if the text had been read in one go.  Where an overlap has no such boundary,
the stretch runs on through the next chunk.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch, slices

CHUNK = 65_536  # code points of a chunk without its overlap
OVERLAP = 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """A vocabulary and its pre-token pattern, sent to the tasks; a worker builds its encoder once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.name = f"{path}|{pattern}"
        self.pattern = pattern
        self._ranks = spark.sparkContext.broadcast(read_ranks(path))  # bounded: one vocabulary

    def __getstate__(self):
        return self.name, self.pattern, self._ranks

    def __setstate__(self, state):
        self.name, self.pattern, self._ranks = state

    def encoder(self) -> tiktoken.Encoding:
        if self.name not in _BUILT:
            _BUILT[self.name] = tiktoken.Encoding(
                self.name, pat_str=self.pattern, mergeable_ranks=self._ranks.value, special_tokens={}
            )
        return _BUILT[self.name]

    def encode(self, text: str) -> list[int]:
        if _LONG_RUN.search(text) is None:
            return self.encoder().encode_ordinary(text)
        # the library's own matcher gives up on very long runs of white space
        one = self.encoder()._encode_single_piece
        return [i for m in _compiled(self.pattern).finditer(text) for i in one(m.group().encode())]

    def boundaries(self, text: str, first: int, last: int) -> list[int]:
        """Pre-token starts in [first, last) that follow a non-space and precede a space."""
        found = (m.start() for m in _compiled(self.pattern).finditer(text))
        return [p for p in found if first <= p < last and p and text[p].isspace() and not text[p - 1].isspace()]


_BUILT: dict[str, tiktoken.Encoding] = {}
_LONG_RUN = regex.compile(r"\s{2000}")


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _cut(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows (at, k, chunk) of texts (at, text)."""
    for batch in batches:
        for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist()):
            starts = range(0, max(1, len(text)), size)
            for k in range(0, len(starts), 64):
                part = starts[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at] * len(part), pa.binary()),
                        pa.array(range(k, k + len(part)), pa.int32()),
                        pa.array([text[p : p + size + overlap] for p in part], pa.string()),
                    ],
                    names=["at", "k", "chunk"],
                )


def _stretches(long: DataFrame, codec: Codec, size: int, overlap: int, scratch: Scratch) -> DataFrame:
    """(at, k, piece): the stretches of each text between seams, in the order of k."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("chunk").to_pylist()
            ints = pa.list_(pa.int32())
            heads = pa.array([codec.boundaries(t, 0, overlap) for t in texts], ints)
            tails = [[p - size for p in codec.boundaries(t, size, size + overlap)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("k"), batch.column("chunk"), heads, pa.array(tails, ints)],
                names=["at", "k", "chunk", "heads", "tails"],
            )

    chunks = long.mapInArrow(lambda b: _cut(b, size, overlap), "at binary, k int, chunk string")
    chunks = chunks.repartition("at", "k")
    chunks = chunks.mapInArrow(scanned, "at binary, k int, chunk string, heads array<int>, tails array<int>")
    chunks = scratch.keep(chunks, "chunks")
    before = chunks.select("at", (F.col("k") + 1).alias("k"), "tails")
    seams = chunks.select("at", "k", "heads").join(before, ["at", "k"], "left")
    seams = seams.select("at", "k", F.array_min(F.array_intersect("heads", "tails")).alias("seam"))
    text = W.partitionBy("at").orderBy("k")  # a few numbers for each chunk of one text
    seams = seams.withColumns(
        {
            "last": F.lead("k").over(text).isNull(),
            "stop": F.lead("seam").over(text),
            "first": F.max(F.when(F.col("seam").isNotNull() | (F.col("k") == 0), F.col("k"))).over(text),
        }
    )
    start = F.coalesce("seam", F.lit(0))
    stop = F.when(F.col("last"), F.lit(size + overlap)).otherwise(size + F.coalesce("stop", F.lit(0)))
    own = F.substring(F.col("chunk"), start + 1, stop - start)
    parts = chunks.select("at", "k", "chunk").join(seams, ["at", "k"]).select("at", "first", "k", own.alias("own"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: x["own"])
    return parts.groupBy("at", F.col("first").alias("k")).agg(F.array_join(joined, "").alias("piece"))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_col: str = "ids",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with the token ids of its texts in ``ids_col`` (in place of a like-named column).

    No special tokens.  Null and empty texts have no ids.  Every row is encoded, repeated rows
    too; long texts are matched by a digest of the text, so that equal ones are encoded once and
    null or repeated ids do no harm.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    scratch = Scratch(docs.sparkSession, "bpe")

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        found = [np.array(codec.encode(t or ""), np.int32) for part in slices(texts) for t in part.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))

    is_long = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    long = docs.filter(is_long).select(digest.alias("at"), F.col(text_col).alias("text")).dropDuplicates(["at"])
    pieces = scratch.keep(_stretches(long, codec, chunk, overlap, scratch), "pieces").repartition("at", "k")
    encoded = pieces.select("at", F.struct("k", ids_of("piece").alias("ids")).alias("part"))
    whole = encoded.groupBy("at").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ids"])).alias("__ids")
    )
    rest = docs.drop(ids_col)
    short_rows = rest.filter(~is_long).withColumn(ids_col, ids_of(text_col))
    long_rows = rest.filter(is_long).withColumn("__at", digest).join(whole.withColumnRenamed("at", "__at"), "__at")
    return short_rows.unionByName(long_rows.withColumn(ids_col, F.col("__ids")).drop("__at", "__ids"))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids_col`` joined in ``out_col``; null ids decode to no bytes."""
    codec = Codec(df.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        decode_bytes = codec.encoder().decode_bytes
        found = [decode_bytes(i or []) for part in slices(ids) for i in part.to_pylist()]
        return pa.array(found, pa.binary())

    return df.withColumn(out_col, bytes_of(ids_col))
