"""Registered queries of the numbered operators, each next to its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetrace.llm import (
    bpe,
    decontaminate,
    divergence,
    licences,
    linecrf,
    lines,
    merkle,
    neardup,
    partcodes,
    ppm,
    quality,
    shards,
    toxicity,
)
from cinetrace.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op1_fixity_audit",
    """
WITH r AS (
  SELECT page_id, page_id // 512 AS f, strlen('WARC/1.1' || 'WARC-Type: response' || 'WARC-Target-URI: ' || coalesce(url, '')
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || coalesce(html, '')) + 14 AS n FROM pages),
o AS (
  SELECT page_id, f, n, coalesce(sum(n) OVER (PARTITION BY f ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM r)
SELECT page_id, printf('segment-%010d', f) AS file, CAST(o AS BIGINT) AS "offset",
  CASE page_id % 97 WHEN 3 THEN 'differs' WHEN 5 THEN 'differs' ELSE 'missing' END AS kind,
  CAST(n AS BIGINT) AS length, CASE page_id % 97 WHEN 3 THEN CAST(n AS BIGINT) WHEN 5 THEN CAST(n // 2 AS BIGINT) END AS other_length
FROM o WHERE page_id % 97 IN (3, 5, 8)""",
)
def fixity_audit(spark: SparkSession, root: str) -> DataFrame:
    """A replica with flipped last bytes, cut records and lost ones against the archive of all pages."""
    scratch = Scratch(spark, "archive")
    records = scratch.keep(merkle.archive(table(spark, root, "pages")), "records")
    record, n = F.col("record"), F.octet_length("record")
    damage = F.pmod("record_id", F.lit(97))
    replica = records.filter(~damage.eqNullSafe(F.lit(8))).withColumn(
        "record",
        F.when(damage == 3, F.concat(F.substring(record, F.lit(1), n - 1), F.lit(b"#")))
        .when(damage == 5, F.substring(record, F.lit(1), (n / 2).cast("int")))
        .otherwise(record),
    )
    return merkle.audit(merkle.leaves(records), merkle.leaves(replica)).withColumnRenamed("record_id", "page_id")


@query("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query(
    "op3_near_duplicates",
    f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS s FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
)
def near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return neardup.groups(table(spark, root, "documents"))


@query(
    "op4_line_dedup",
    f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, l, list_transform(l, lambda x: {_LOWER.format(f"trim(x, {_SPACE})")}) AS k FROM d),
f AS (SELECT u FROM (SELECT doc_id, unnest(list_distinct(k)) AS u FROM k) WHERE length(u) >= 1 GROUP BY u HAVING count(*) >= 10),
h AS (SELECT list(u) AS hot FROM f),
s AS (SELECT doc_id, len(l) AS n, list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(coalesce(hot, []), k[i])), lambda i: l[i]) AS s FROM k, h)
SELECT doc_id, n AS n_lines, n - len(s) AS n_dropped, sha256(coalesce(array_to_string(s, chr(10)), '')) AS kept_sha256 FROM s""",
)
def line_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = lines.drop_frequent_lines(table(spark, root, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_toxicity")
def toxic_scores(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, root, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, root, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = quality.train(docs, table(spark, root, "labels"))
    return quality.grade(docs.select("doc_id", "text"), model).drop("text")


@query("op8_ppm_scores")
def ppm_scores(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    scored = ppm.score(docs, docs.filter(~ppm.held_out(F.col("doc_id"))))
    return scored.withColumn("held_out", ppm.held_out(F.col("doc_id")))


@query("op9_line_labels")
def line_labels(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return linecrf.judge(docs, linecrf.train(docs, table(spark, root, "labels"))).drop("text", "line_labels")


@query("op10_minimax_shards")
def minimax_shards(spark: SparkSession, root: str) -> DataFrame:
    return shards.assign(table(spark, root, "documents"))


@query(
    "op11_source_divergence",
    f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT id, lang, source, {_LOWER.format("u")} AS term FROM (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS u FROM d)),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
gn AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (gn.total + 2 * v.v) AS p
  FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
wn AS (SELECT lang, sum(n) AS total FROM w GROUP BY 1),
q AS (
  SELECT w.lang, w.term, 1 + CAST(1000000000 AS HUGEINT) * (w.n + 2) // (wn.total + 2 * v.v) AS q
  FROM w JOIN wn ON wn.lang = w.lang JOIN v ON v.lang = w.lang),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3
  UNION ALL
  SELECT x.lang, x.source, y.source, 0 FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  WHERE x.lang NOT IN (SELECT lang FROM v)),
terms AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
)
def source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit(table(spark, root, "documents"))


@query("op12_license_scan")
def license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licences.scan(table(spark, root, "documents")).drop("places", "expressions")


def _codes_sql(rounds: int) -> str:
    """The rounds of the codebooks, written out."""
    gap = "list_sum(list_transform(range(1, len(e.x) + 1), lambda i: (e.x[i] - b.x[i]) * (e.x[i] - b.x[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
n{r} AS (SELECT e.row, e.p, min(CAST({gap} AS BIGINT) * 64 + b.e) AS m FROM e JOIN b{r} b ON b.p = e.p GROUP BY e.row, e.p)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (
  SELECT p, c AS e, i, CAST(floor_div AS BIGINT) AS x FROM (
    SELECT p, c, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (
      SELECT n.p, n.m % 64 AS c, i, sum(e.x[i]) AS s, count(*) AS n
      FROM n{r} n JOIN e ON e.row = n.row AND e.p = n.p, (SELECT unnest(range(1, (SELECT max(len(x)) FROM e) + 1)) AS i) GROUP BY 1, 2, 3))),
b{r + 1} AS (
  SELECT b.p, b.e, coalesce(v.x, b.x) AS x FROM b{r} b
  LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM u{r} GROUP BY p, e) v ON v.p = b.p AND v.e = b.e)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (
  SELECT row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row - 1 AS e, x FROM e WHERE row <= 64),{",".join(steps)},
h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
c AS (
  SELECT row, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM n{rounds} GROUP BY row),
l AS (SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM k JOIN c ON c.row = k.row GROUP BY k.label)
SELECT k.vec_id, c.code, c.error, l.label_error, h.h AS codebooks_sha256
FROM k JOIN c ON c.row = k.row JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""


@query("op13_part_codes", _codes_sql(partcodes.ROUNDS))
def part_codes(spark: SparkSession, root: str) -> DataFrame:
    return partcodes.compress(table(spark, root, "embeddings"))
