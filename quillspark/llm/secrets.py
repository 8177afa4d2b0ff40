"""Secret scans with multipart credential linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, table

#: Base kinds in their order: pattern, and the group and least length that a match must have.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Weak kinds, reported only beside their complements, and the part of a credential that each is. A key is a whole run of any
#: length; it is tried at its first character only and nothing is given back, so a run is read four times at most.
WEAK = (
    ("weak_id", r"""(?:A(?:SIA|ROA|IDA|GPA)[A-Z0-9]{12,}|(?i:client|account|tenant|access)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,})""", "I"),
    ("weak_key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+", "S"),
    ("weak_endpoint", r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", "E"),
)
#: Parts that base kinds are; long hex strings are often checksums and complete nothing.
PARTS = {"access": "I", "assign": "S"}
#: Code points between the end of a part of a credential and the start of the next at most.
SCOPE = 256

KINDS = [x[0] for x in BASE] + [x[0] for x in WEAK]


def _matches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, th, kind (its place in KINDS), start, end: all leftmost non-overlapping matches of
    each kind. A text is split at the matches; the pieces' lengths give positions. Only texts with a match go on."""
    rx = [x[1] for x in (*BASE, *WEAK)]
    split = F.array(*[F.struct(F.lit(i).alias("kind"), F.transform(F.split(F.col("text"), r, -1), lambda x: F.char_length(x)).alias("gaps")) for i, r in enumerate(rx)])
    hit = docs.select("doc_id", "text", F.explode(F.filter(split, lambda x: F.size(x["gaps"]) > 1)).alias("x")).select("doc_id", "text", "x.*")
    found = F.when(F.col("kind") == 0, F.regexp_extract_all("text", F.lit(rx[0]), F.lit(0)))
    for i, r in enumerate(rx[1:], 1):
        found = found.when(F.col("kind") == i, F.regexp_extract_all("text", F.lit(r), F.lit(0)))
    each = hit.select("doc_id", F.xxhash64("text").alias("th"), "kind", "gaps", F.posexplode(found).alias("i", "m"))
    each = each.select("doc_id", "th", "kind", "i", F.get("gaps", F.col("i")).alias("gap"), F.char_length("m").alias("n"), F.when(F.col("kind") == 0, F.char_length(F.regexp_extract("m", rx[0], BASE[0][2]))).otherwise(F.char_length("m")).alias("value"))
    each = each.distinct()  # rows that repeat doc_id and text
    run = Window.partitionBy("doc_id", "th", "kind").orderBy("i")
    least = F.element_at(F.array(*[F.lit(x[3]) for x in BASE], *[F.lit(0) for _ in WEAK]), F.col("kind") + 1)
    return each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)).where(F.col("value") >= least).select("doc_id", "th", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans whose complements stand within scope: identifier and secret need each other, an endpoint needs
    both. Of the parts that start within scope of a span's end, the one that reaches furthest decides whether any is in
    reach: a running maximum over a text's parts in order, one row for each part and each span, however many are near."""
    part = F.element_at(F.array(*[F.lit(PARTS.get(x[0])) for x in BASE], *[F.lit(x[2]) for x in WEAK]), F.col("kind") + 1)
    parts = spans.withColumn("part", part).where("part is not null")
    is_weak = F.col("kind") >= len(BASE)
    seen = parts.where("part <> 'E'").withColumns({"at": F.col("start"), "asks": F.lit(False)})
    asks = parts.where(is_weak).withColumns({"at": F.col("end") + scope, "asks": F.lit(True)})
    run = Window.partitionBy("doc_id", "th").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = lambda p: F.coalesce(F.max(F.when(~F.col("asks") & (F.col("part") == p), F.col("end"))).over(run) >= F.col("start") - scope, F.lit(False))
    near = seen.unionByName(asks).withColumns({"has_i": far("I"), "has_s": far("S")})
    return near.where("asks and (part = 'I' or has_i) and (part = 'S' or has_s)").select("doc_id", "th", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text, ...) to one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are reported wherever they stand. Identifiers, tokens and endpoints that alone say little are weak
    candidates: they are reported only if complementary parts of a credential co-occur within `scope` code
    points of the same text, from the end of the one to the start of the other. spans lists all as kind:start:end in code points, by start, then kind; a weak span
    may lie within a base one. Null texts count as empty and have none; rows that repeat doc_id and text repeat
    their result, rows that repeat a doc_id with another text have their own. Null doc_ids are kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = cut(_matches(base))  # few rows, used for base spans, parts and candidates
    spans = spans.where(F.col("kind") < len(BASE)).union(_linked(spans, scope))
    per = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s")).alias("p")
    d = base.select("doc_id", F.xxhash64("text").alias("th")).alias("d")
    out = d.join(per, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th")), "left").select("d.doc_id", F.expr("coalesce(s, cast(array() as array<struct<start:bigint,kind:int,end:bigint>>))").alias("s"))
    count = lambda i: F.size(F.filter("s", lambda x: x["kind"] == i)).cast("long")
    base_only = F.filter("s", lambda x: x["kind"] < len(BASE))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base_only).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _found(kind: int, rx: str) -> str:
    return f"SELECT doc_id, {kind} AS kind, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}') AS ms FROM d"


_RX = [x[1].replace("'", "''") for x in (*BASE, *WEAK)]
#: The same rows in SQL. Its patterns know no look-around, so keys are whole runs that are tested afterwards.
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(_found(i, "[A-Za-z0-9+/_-]+" if KINDS[i] == "weak_key" else rx) for i, rx in enumerate(_RX))}),
e AS (SELECT doc_id, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM k),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM e),
s AS (
  SELECT doc_id, kind, stop - length(m) AS start, stop, CASE kind WHEN 0 THEN 'S' WHEN 1 THEN 'I' WHEN 3 THEN 'I' WHEN 4 THEN 'S' WHEN 5 THEN 'E' END AS part FROM p
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '{_RX[0]}', 2)) >= 8 WHEN 1 THEN length(m) >= 16 WHEN 4
             THEN length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
n AS (SELECT *, start AS place, false AS asks FROM s WHERE part <> 'E' UNION ALL SELECT *, stop + {SCOPE}, true FROM s WHERE kind >= 3),
f AS (SELECT *, coalesce(max(CASE WHEN NOT asks AND part = 'I' THEN stop END) OVER w >= start - {SCOPE}, false) AS has_i,
             coalesce(max(CASE WHEN NOT asks AND part = 'S' THEN stop END) OVER w >= start - {SCOPE}, false) AS has_s
      FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY place, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT doc_id, kind, start, stop FROM s WHERE kind < 3
      UNION ALL SELECT doc_id, kind, start, stop FROM f WHERE asks AND (part = 'I' OR has_i) AND (part = 'S' OR has_s)),
j AS (SELECT doc_id, kind, start, stop, (['{"', '".join(KINDS)}'])[kind + 1] || ':' || start || ':' || stop AS said FROM a),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(said, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind, stop) AS spans FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
