"""Source divergence audit: how far the word use of each source lies from the others of its language.

Chunk factorization: texts are cut at white space, which no term crosses.  Chunks are counted
document by document and summed up inside a task, each globally distinct chunk is cut into terms
once, and its terms are joined back to the sums.  A first pass counts the documents of every chunk, which
tells the terms that may be kept; a second one counts the uses of their chunks by source.  A document that
uses a term in several chunks counts once for it: where the threshold depends on that, the second pass
brings the numbers of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch, ascii_lower

TERM = r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"
MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
PIECE = 8 << 20  # bytes of text that a task counts before it passes the sums on
ROWS = 64  # rows that a piece grows by
BUCKET = 4 << 20  # bytes of text for each bucket of chunks, so that buckets do not grow with the input
BLOCK = 256  # terms that are compared between sources at once
BITS = 24  # of the chunk prints that spare the second pass needless chunks


class _Uses(NamedTuple):
    """Chunk uses of one piece: a row per document and distinct chunk."""

    chunks: pa.Array  # by code
    crcs: np.ndarray  # by code
    doc: np.ndarray
    code: np.ndarray
    n: np.ndarray
    columns: dict[str, tuple[np.ndarray, pa.Array]]  # per document a code, and the values by code


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[tuple[pa.Table, int]]:
    """Rows of a task in pieces of bounded size, each with the number of its first row; no two rows share one."""
    number, held, size = TaskContext.get().partitionId() << 40, [], 0

    def whole() -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        pa.default_memory_pool().release_unused()
        return table

    for batch in batches:
        for at in range(0, len(batch), ROWS):
            held.append(batch.slice(at, ROWS))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size > piece:
                rows = whole()
                yield rows, number
                number, size = number + len(rows), 0
    if held:
        yield whole(), number


def _crcs(chunks: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(c) for c in chunks.cast(pa.binary()).to_pylist()], np.int64)


def _marked(crcs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which chunks have their print in a bitmap of a power of two bits."""
    return prints[crcs >> (33 - len(prints).bit_length())]


def _uses(rows: pa.Table, wanted: np.ndarray | None = None) -> _Uses:
    """Counts of the chunks of every document, of those whose print is ``wanted``."""
    whole = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
    lists = pc.ascii_split_whitespace(whole(rows.column("text")))
    lengths = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    del lists
    chunks, code = coded.dictionary, coded.indices.to_numpy()
    size = max(1, len(chunks))
    crcs = _crcs(chunks)
    kept = pc.greater(pc.binary_length(chunks), 0).to_numpy(zero_copy_only=False) if wanted is None else _marked(crcs, wanted)
    key = np.repeat(np.arange(len(lengths)) * size, lengths)
    key += code
    if not kept.all():
        key = key[kept[code]]
    del code
    key.sort()
    fresh = _starts(key)
    n = np.diff(fresh, append=len(key)).astype(np.int32)
    columns = {}
    for name in rows.column_names:
        if name != "text":
            values = whole(rows.column(name)).dictionary_encode()
            columns[name] = (values.indices.to_numpy().astype(np.int64), values.dictionary)
    key = key[fresh]
    return _Uses(chunks, crcs, (key // size).astype(np.int32), (key % size).astype(np.int32), n, columns)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return np.flatnonzero(first)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _by_bucket(crcs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chunks by bucket, the buckets that occur, and where each begins and the last ends."""
    of = crcs % buckets
    order = np.argsort(of, kind="stable")
    first = _starts(of[order])
    return order, of[order][first], np.append(first, len(order))


def _repeated(names: pa.Array, n: int) -> pa.Array:
    """The same names in every row."""
    return _lists(names.take(_ints(np.tile(np.arange(len(names)), n))), np.arange(n + 1) * len(names))


def _document_counts(piece: int, buckets: int):
    """In how many documents of a piece each chunk stands; one row per bucket of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _pieces(batches, piece):
            uses = _uses(rows)
            lang, langs = uses.columns["lang"]
            size = max(1, len(uses.chunks))
            key, docs = np.unique(lang[uses.doc] * size + uses.code, return_counts=True)
            chunks = uses.chunks.take(pa.array(key % size))
            order, bucket, cuts = _by_bucket(uses.crcs[key % size], buckets)
            at = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket),
                    _repeated(langs, len(bucket)),
                    _lists(_ints((key // size)[order]), cuts),
                    _lists(chunks.take(at), cuts),
                    _lists(_ints(docs[order]), cuts),
                ],
                ["bucket", "langs", "lang", "chunks", "docs"],
            )

    return run


def _codes(*columns: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Columns of one kind as codes of one dictionary."""
    both = pa.chunked_array([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], pa.string())
    coded = both.combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary


def _flat(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).flatten()


def _named(rows: pa.Table, names: str, codes: str) -> tuple[np.ndarray, pa.Array]:
    """Codes that hold for all rows, and their names; each row has numbered its own."""
    (own,), dictionary = _codes(_flat(rows, names))
    sizes = [pc.list_value_length(rows.column(c)).to_numpy() for c in (names, codes)]
    return own[_flat(rows, codes).to_numpy() + np.repeat(np.cumsum(sizes[0]) - sizes[0], sizes[1])], dictionary


def _add_up(rows: pa.Table) -> pa.Table:
    """The distinct chunks of a bucket, each with its documents by language."""
    lang, langs = _named(rows, "langs", "lang")
    (chunk,), chunks = _codes(_flat(rows, "chunks"))
    key, at = np.unique(chunk * len(langs) + lang, return_inverse=True)
    docs = np.zeros(len(key), np.int64)
    np.add.at(docs, at, _flat(rows, "docs").to_numpy())
    first = _starts(key // len(langs))
    cuts = np.append(first, len(key))
    columns = [chunks.take(pa.array(key[first] // len(langs))), _lists(langs.take(pa.array(key % len(langs))), cuts), _lists(pa.array(docs), cuts)]
    return pa.Table.from_arrays(columns, ["chunk", "langs", "docs"])


def _source_counts(wanted: bytes, doubtful: bytes, piece: int, buckets: int):
    """Uses of each wanted chunk by source, and the documents of doubtful ones; one row per bucket of chunks.

    ``sizes`` of ``source`` and ``ns``, and ``told`` of ``ids``, belong to each of ``chunks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").astype(bool) for b in (wanted, doubtful)]
        for rows, first in _pieces(batches, piece):
            uses = _uses(rows, bits[0])
            (lang, langs), (source, sources) = uses.columns["lang"], uses.columns["source"]
            size, most = max(1, len(uses.chunks)), max(1, len(sources))
            # chunks of a bucket side by side, below them languages, sources and documents
            order, _, _ = _by_bucket(uses.crcs, buckets)
            place = np.empty(size, np.int64)
            place[order] = np.arange(len(order))
            key = (place[uses.code] * len(langs) + lang[uses.doc]) * most + source[uses.doc]
            order2 = np.argsort(key, kind="stable")
            key, doc, n = key[order2], uses.doc[order2], uses.n[order2]
            each = _starts(key)  # of chunk, language and source
            sums = np.add.reduceat(n, each) if len(n) else n
            pair = key[each] // most
            row = _starts(pair)  # of chunk and language
            code = order[pair[row] // max(1, len(langs))]
            _, bucket, cuts = _by_bucket(uses.crcs[code], buckets)
            spread = np.append(row, len(each))
            docs = np.append(each, len(key))[spread]
            told = np.diff(docs) * _marked(uses.crcs[code], bits[1])
            ids = first + doc[np.repeat(told > 0, np.diff(docs))].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket),
                    _repeated(langs, len(bucket)),
                    _lists(_ints(pair[row] % max(1, len(langs))), cuts),
                    _lists(uses.chunks.take(pa.array(code)), cuts),
                    _lists(_ints(np.diff(spread)), cuts),
                    _repeated(sources, len(bucket)),
                    _lists(_ints(key[each] % most), spread[cuts]),
                    _lists(_ints(sums), spread[cuts]),
                    _lists(_ints(told), cuts),
                    _lists(pa.array(ids), np.append(0, np.cumsum(told))[cuts]),
                ],
                ["bucket", "langs", "lang", "chunks", "sizes", "sources", "source", "ns", "told", "ids"],
            )

    return run


def _terms_back(counts: pa.Table, wanted: pa.Table) -> pa.Table:
    """Join the terms of a bucket's chunks back: uses by language, term and source; documents of open terms."""
    names = ["lang", "term", "source", "n", "id"]
    own_lang, own_langs = _named(counts, "langs", "lang")
    (own_names, want_lang), langs = _codes(own_langs, wanted.column("lang"))
    lang = own_names[own_lang]
    (chunk, want_chunk), _ = _codes(_flat(counts, "chunks"), wanted.column("chunk"))
    source, sources = _named(counts, "sources", "source")
    (term,), terms = _codes(wanted.column("term"))
    key, want = chunk * len(langs) + lang, want_chunk * len(langs) + want_lang
    order = np.argsort(want, kind="stable")
    want, term, open_ = want[order], term[order], wanted.column("open").to_numpy()[order]

    def matches(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(want, keys, "left"), np.searchsorted(want, keys, "right")
        own = np.repeat(np.arange(len(keys)), high - low)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[own]

    own, hit = matches(np.repeat(key, _flat(counts, "sizes").to_numpy()))
    group, at = np.unique((term[hit] * len(langs) + want[hit] % len(langs)) * max(1, len(sources)) + source[own], return_inverse=True)
    n = np.zeros(len(group), np.int64)
    np.add.at(n, at, _flat(counts, "ns").to_numpy()[own])
    pair = group // max(1, len(sources))
    uses = [langs.take(pa.array(pair % len(langs))), terms.take(pa.array(pair // len(langs))), sources.take(pa.array(group % max(1, len(sources))))]
    uses = pa.Table.from_arrays([*uses, pa.array(n), pa.nulls(len(n), pa.int64())], names)
    own, hit = matches(np.repeat(key, _flat(counts, "told").to_numpy()))
    own, hit = own[open_[hit]], hit[open_[hit]]
    who = np.unique(np.stack([term[hit], want[hit] % len(langs), _flat(counts, "ids").to_numpy()[own]]), axis=1)
    told = [langs.take(pa.array(who[1])), terms.take(pa.array(who[0])), pa.nulls(who.shape[1], pa.string())]
    return pa.concat_tables([uses, pa.Table.from_arrays([*told, pa.nulls(who.shape[1], pa.int64()), pa.array(who[2])], names)])


def _prints(chunks: DataFrame, bits: int) -> bytes:
    """The prints of all chunks as a bitmap of 2**bits bits, whatever their number."""
    at = F.shiftrightunsigned(F.crc32(F.col("chunk").cast("binary")), 32 - bits)
    words = chunks.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def terms_of(chunk: Column) -> Column:
    return F.transform(F.regexp_extract_all(chunk, F.lit(TERM), 1), ascii_lower)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in units of 1 / UNIT; exact at any count, 1 where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(count) + F.lit(2)) * F.lit(UNIT)
    whole = F.call_function("div", top, wide(total) + F.lit(2) * wide(terms))
    return F.when(terms > 0, F.lit(1) + whole).otherwise(F.lit(1)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_terms(
    docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, piece: int = PIECE, bits: int = BITS
) -> DataFrame:
    """(lang, term, source, n): uses of every term that stands in ``min_docs`` documents of its lang.

    ``docs`` has columns text, lang and source without nulls.  Let a term stand in the chunks c.
    Its documents are at least max(docs(c)) and at most sum(docs(c)); where the threshold lies
    between the two, the documents of its chunks, all of them rare, are told apart by their numbers.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, total // BUCKET)
    packed = "bucket long, langs array<string>, lang array<int>, chunks array<string>"
    counted = docs.select("text", "lang").mapInArrow(_document_counts(piece, buckets), f"{packed}, docs array<int>")
    vocabulary = counted.groupBy("bucket").applyInArrow(_add_up, "chunk string, langs array<string>, docs array<long>")
    vocabulary = scratch.keep(vocabulary.withColumn("terms", terms_of(F.col("chunk"))).filter(F.size("terms") > 0), "vocabulary")
    found = vocabulary.select("chunk", "terms", F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("docs").alias("docs"))))
    found = found.select("lang", "chunk", "docs", F.explode("terms").alias("term"))
    bounds = found.groupBy("lang", "term").agg(F.sum("docs").alias("most"), F.max("docs").alias("least"))
    bounds = scratch.keep(bounds.filter(F.col("most") >= min_docs), "bounds")
    wanted = found.join(bounds, ["lang", "term"]).select("lang", "chunk", "term", (F.col("least") < min_docs).alias("open"))
    wanted = scratch.keep(wanted.withColumn("bucket", F.pmod(F.crc32(F.col("chunk").cast("binary")), F.lit(buckets))), "wanted")
    counts = docs.select("text", "lang", "source").mapInArrow(
        _source_counts(_prints(wanted, bits), _prints(wanted.filter("open"), bits), piece, buckets),
        f"{packed}, sizes array<int>, sources array<string>, source array<int>, ns array<int>, told array<int>, ids array<long>",
    )
    uses = counts.groupBy("bucket").cogroup(wanted.groupBy("bucket"))
    uses = uses.applyInArrow(_terms_back, "lang string, term string, source string, n long, id long")
    uses = scratch.keep(uses, "uses")
    term = ["lang", "term"]
    told = uses.filter("id IS NOT NULL").select(*term, "id").distinct().groupBy(*term).agg(F.count(F.lit(1)).alias("docs"))
    sure = bounds.filter(F.col("least") >= min_docs).select(*term)
    kept = scratch.keep(sure.unionByName(told.filter(F.col("docs") >= min_docs).select(*term)), "kept")
    counts = uses.filter("id IS NULL").groupBy(*term, "source").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.join(kept, term), "counts")
    scratch.only(counts)
    return counts


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms for all pairs of sources; rows without a term tell the shares of absent terms."""
    base = pdf[pdf["term"].isna()].sort_values("source")
    own = pdf[pdf["term"].notna()]
    names = base["source"].to_numpy(object)
    at = {name: i for i, name in enumerate(names)}
    column, terms = pd.factorize(own["term"])
    shares = np.repeat(base["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    shares[[at[s] for s in own["source"]], column] = own["p"].to_numpy(np.int64)
    first, second, value = [], [], []
    for i in range(len(names) - 1):
        p, q = shares[i], shares[i + 1 :]
        first += [names[i]] * len(q)
        second += list(names[i + 1 :])
        value += ((q - p) ** 2 // (q + p)).sum(axis=1).tolist()
    lang = pd.Series([pdf["lang"].iloc[0]] * len(value), dtype=object)
    return pd.DataFrame({"lang": lang, "a": pd.Series(first, dtype=object), "b": pd.Series(second, dtype=object), "value": pd.Series(value, dtype="int64")})


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    piece: int = PIECE,
    bits: int = BITS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): gaps between sources, and the terms that set a source apart.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms above the
    language's own share.  Every row is a document, repeated ones too.  Nulls of the three columns
    count as empty; an empty language or source is a group like others.  A text without a term adds
    nothing but its group.  A language without kept terms has value 0 for each of its pairs and no
    terms.  Ties are ranked by item.  Other columns are not read.  An empty table gives no rows.

    ``piece`` bytes of text are counted at once, and 2**``bits`` prints of chunks spare the second pass needless
    ones; neither changes the result.

    What grows with pairs of sources is the result itself; pairs are summed up over blocks of terms, and
    a block holds one number per source and term.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    counts = count_terms(rows, scratch, min_docs, piece, bits)
    whole = scratch.keep(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")), "language")
    langs = whole.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.keep(groups.na.fill(0, ["total", "all_total", "terms"]), "groups")

    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)).cast("long")
    used = counts.join(groups, ["lang", "source"]).withColumn("p", p)
    own = used.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    absent = groups.select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        _share(F.lit(0), F.col("total"), F.col("terms")).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
    )
    sums = own.unionByName(absent).groupBy("lang", "block").applyInPandas(_pair_sums, "lang string, a string, b string, value long")
    sums = scratch.keep(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )

    q = _share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    terms = used.join(whole, ["lang", "term"]).withColumn("q", q).filter("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(
        terms.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    )
    return parts.select("lang", "source", "part", "item", "value", "rank")
