"""Keys, predicates and parsers of document text as column expressions. A null text gives a null, which filters drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import BLANK, strip_serials
from quillspark.plans.registry import query, table

#: Characters that separate clauses, and page references.
CLAUSE = "[,.;:!?|()，。；：！？、（）\\n]+"
PAGE = "(?:第[0-9]+页|[Pp][0-9]+(?:-[0-9]+)?)"
PUNCTUATION = "[,.;:!?|()\\[\\]{}\"'%*#，。；：！？、（）【】]+"
SERIAL = "^[ \\t]*(?:\\([0-9]{1,3}\\)|[0-9]+(?:\\.[0-9]+)*[.)]?)[ \\t]+"
HEADING = "^(?:第[0-9一二三四五六七八九十百]+[章节条]|[一二三四五六七八九十]+、|[0-9]+(?:\\.[0-9]+)*[.)]?[ \\t]+[^ \\t])"
PAGE_NUMBER = "^[-—]*(?:[0-9]{1,4}|第[0-9]+页)[-—]*$"
#: Capital digits and units of Chinese amounts.
DIGITS = "零壹贰叁肆伍陆柒捌玖"
SMALL_UNITS = {"拾": 10, "佰": 100, "仟": 1000}
LARGE_UNITS = {"万": 10_000, "亿": 100_000_000}
#: Words that are no part of a person's name.
NOT_NAMES = ("small", "large", "red")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def is_heading(line: Column, most: int = 36) -> Column:
    """A numbered line, or a short one without a full stop."""
    return line.rlike(HEADING) | ((F.char_length(squeezed(line)).between(4, most)) & ~line.rlike("[.。!?！？;；,，][ \\t]*$"))


def is_noise(line: Column) -> Column:
    """Empty, a page number, or under four characters and no numbered heading."""
    c = squeezed(line)
    return (c == "") | c.rlike(PAGE_NUMBER) | (~line.rlike(HEADING) & (F.char_length(c) < 4))


def similarity_key(text: Column) -> Column:
    """Lower-cased, page references alike, punctuation and blanks as one space."""
    t = F.regexp_replace(strip_serials(text), PAGE, "<PAGE>")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, PUNCTUATION, " "), BLANK, " ")))


def token_of(text: Column) -> Column:
    """The token by which evidence is clustered: digits alike, no punctuation; null if under four other characters."""
    t = F.regexp_replace(squeezed(strip_serials(text)), "[0-9]+", "#")
    t = F.lower(F.trim(F.regexp_replace(t, PUNCTUATION, " ")))
    return F.when(F.char_length(F.regexp_replace(t, "[# ]", "")) >= 4, t)


def longest_clauses(text: Column, least: int = 4, most: int = 6) -> Column:
    """The longest different clauses of a text, longest first, by value in a tie; a text without one gives its
    first 12 and last 10 characters."""
    parts = F.array_distinct(F.filter(F.transform(F.split(text, CLAUSE), squeezed), lambda x: F.char_length(x) >= least))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array_distinct(F.array(F.left(text, F.lit(12)), F.right(text, F.lit(10)))))
    ranked = F.sort_array(F.transform(parts, lambda x: F.struct((-F.char_length(x)).alias("l"), x.alias("v"))))
    return F.slice(F.transform(ranked, lambda x: x["v"]), 1, most)


def containment(part: Column, whole: Column) -> Column:
    """The shorter length over the longer if one text holds the other, else 0; two empty texts are 0."""
    a, b = F.char_length(part), F.char_length(whole)
    holds = (F.least(a, b) > 0) & (whole.contains(part) | part.contains(whole))
    return F.when(holds, F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def context(text: Column, at: Column, around: int) -> Column:
    """Characters around position `at` (from 1)."""
    start = F.greatest(F.lit(1), at - around)
    return F.substring(text, start, at + around - start)


def in_order(text: Column, parts: list[str]) -> Column:
    """Whether all parts stand in the text, one after the other."""
    pos = F.lit(1)  # where the search goes on; 0 once a part is missing
    for p in parts:
        found = F.when(pos > 0, F.position(F.lit(p), text, pos)).otherwise(0)
        pos = F.when(found > 0, found + len(p)).otherwise(0)
    return pos > 0


def person_name(text: Column) -> Column:
    """A text as a person's name: brackets and separators go; null if a word is barred or the length is off."""
    t = F.trim(F.regexp_replace(text, "[()\\[\\]:：/|,]+", " "))
    barred = F.lower(t).rlike("(^| )(" + "|".join(NOT_NAMES) + ")( |$)")
    return F.when(~barred & t.rlike("^([A-Za-z][A-Za-z ]{1,19}|[\\x{4E00}-\\x{9FFF}]{2,4})$"), t)


def amount_of_capitals(text: Column) -> Column:
    """A Chinese amount in capitals as a number; units without digits, other characters and nulls give null.

    A fold over the characters: `whole` sums units of ten thousand and more, `part` those below, `digit` waits for
    its unit.
    """
    names = ("whole", "part", "digit", "cents")
    zero = F.lit(0.0)

    def state(s: Column | None = None, **x: Column) -> Column:
        numbers = [x.get(n, zero if s is None else s[n]).alias(n) for n in names]
        flags = [x.get(n, F.lit(n == "ok") if s is None else s[n]).alias(n) for n in ("seen", "ok")]
        return F.struct(*numbers, *flags)

    def step(s: Column, c: Column) -> Column:
        digit = F.position(c, F.lit(DIGITS))
        below = s["part"] + s["digit"]
        out = F.when(c.isin("", "整", "正"), state(s))
        for unit, n in SMALL_UNITS.items():
            out = out.when(c == unit, state(s, part=s["part"] + s["digit"] * n, digit=zero))
        out = out.when(c == "万", state(s, whole=s["whole"] + below * LARGE_UNITS["万"], part=zero, digit=zero))
        out = out.when(c == "亿", state(s, whole=(s["whole"] + below) * LARGE_UNITS["亿"], part=zero, digit=zero))
        out = out.when(c.isin("元", "圆", "园"), state(s, whole=s["whole"] + below, part=zero, digit=zero))
        out = out.when(c == "角", state(s, cents=s["cents"] + s["digit"] * 10, digit=zero)).when(c == "分", state(s, cents=s["cents"] + s["digit"], digit=zero))
        out = out.when(digit > 0, state(s, digit=(digit - 1).cast("double"), seen=F.lit(True)))
        return out.otherwise(state(s, ok=F.lit(False)))

    value = lambda s: F.when(s["ok"] & s["seen"], s["whole"] + s["part"] + s["digit"] + s["cents"] / 100)
    return F.aggregate(F.split(text, ""), state(), step, value)


_BLANK_SQL = "'" + BLANK + "'"
_LINES = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)"
_squeezed_sql = lambda x: f"regexp_replace({x}, {_BLANK_SQL}, '', 'g')"
_stripped_sql = lambda x: f"regexp_replace({x}, '{SERIAL}', '')"
_PUNCT_SQL = "'" + PUNCTUATION.replace("'", "''") + "'"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))


@query(f"SELECT p_partkey, {_stripped_sql('line')} AS stripped FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '(' || p_size || ') ' WHEN 1 THEN p_size || '.1 ' ELSE p_size || 'x ' END || p_name AS line FROM part)")
def strip_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 3
    line = F.when(kind == 0, F.format_string("(%d) %s", "p_size", "p_name")).when(kind == 1, F.format_string("%d.1 %s", "p_size", "p_name")).otherwise(F.format_string("%dx %s", "p_size", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", strip_serials(line).alias("stripped"))


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '{HEADING}') OR (length({_squeezed_sql('line')}) BETWEEN 4 AND 36 AND NOT regexp_matches(line, '[.。!?！？;；,，][ \t]*$'))) AS headings FROM {_LINES} GROUP BY doc_id")
def heading_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(is_heading(F.col("line"))).alias("headings"))


@query(f"SELECT doc_id, count(*) AS kept FROM (SELECT *, {_squeezed_sql('line')} AS c FROM {_LINES}) WHERE NOT (c = '' OR regexp_matches(c, '{PAGE_NUMBER}') OR (NOT regexp_matches(line, '{HEADING}') AND length(c) < 4)) GROUP BY doc_id")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(~is_noise(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND (regexp_matches(text, '{HEADING}') OR length({_squeezed_sql('text')}) >= 8)")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that may be compared: no marks, and eight characters at least unless numbered."""
    admissible = F.col("text").rlike(HEADING) | (F.char_length(squeezed(F.col("text"))) >= 8)
    return table(spark, sf_dir, "conversations").where((F.col("role") != "system") & admissible).select("conv_id", "turn")


@query(f"SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace({_stripped_sql('text')}, '{PAGE}', '<PAGE>', 'g'), {_PUNCT_SQL}, ' ', 'g'), {_BLANK_SQL}, ' ', 'g')))) AS key FROM documents")
def sim_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(similarity_key(F.col("text")), 256).alias("key"))


@query(f"SELECT doc_id, count(DISTINCT t) AS tokens FROM (SELECT doc_id, CASE WHEN length(regexp_replace(t, '[# ]', '', 'g')) >= 4 THEN t END AS t FROM (SELECT doc_id, lower(trim(regexp_replace(regexp_replace({_squeezed_sql(_stripped_sql('line'))}, '[0-9]+', '#', 'g'), {_PUNCT_SQL}, ' ', 'g'))) AS t FROM {_LINES})) GROUP BY doc_id")
def cluster_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct(token_of(F.col("line"))).alias("tokens"))


@query(f"WITH f AS (SELECT item_id, text, list_distinct(list_filter(list_transform(string_split(regexp_replace(text, '{CLAUSE}', chr(1), 'g'), chr(1)), lambda x: {_squeezed_sql('x')}), lambda x: length(x) >= 4)) AS p FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents)) SELECT item_id, list_transform(list_sort(list_transform(CASE WHEN len(p) > 0 THEN p ELSE list_distinct([left(text, 12), right(text, 10)]) END, lambda x: {{'l': -length(x), 'v': x}})), lambda s: s.v)[1:6] AS parts FROM f")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").union(table(spark, sf_dir, "documents").select(-1 - F.col("doc_id"), "text"))
    return rows.select("item_id", longest_clauses(F.col("text")).alias("parts"))


@query("SELECT page_id, CASE WHEN least(length(a), length(b)) > 0 AND (contains(a, b) OR contains(b, a)) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 0 END AS ratio FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS a, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS b FROM pages)")
def containment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", a.alias("a"), b.alias("b")).select("page_id", containment(F.col("a"), F.col("b")).alias("ratio"))


@query("SELECT page_id, substring(html, greatest(1, p - 20), p + 20 - greatest(1, p - 20)) AS near FROM (SELECT page_id, html, strpos(html, '<h1>') AS p FROM pages) WHERE p > 0")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("p", F.position(F.lit("<h1>"), F.col("html"))).where("p > 0")
    return p.select("page_id", context(F.col("html"), F.col("p"), 20).alias("near"))


@query("SELECT page_id, regexp_matches(html, '(?s)<title>.*<h1>.*</p>') AS present FROM pages")
def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", in_order(F.col("html"), ["<title>", "<h1>", "</p>"]).alias("present"))


@query("SELECT p_partkey, CASE WHEN NOT regexp_matches(lower(p_name), '(^| )(small|large|red)( |$)') AND regexp_matches(p_name, '^[A-Za-z][A-Za-z ]{1,19}$') THEN p_name END AS name FROM part")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", person_name(F.concat(F.lit("["), "p_name", F.lit("]"))).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS amount FROM lineitem")
def capital_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities written in capitals and read back."""
    q = F.col("l_quantity").cast("int")
    digit = lambda n: F.substring(F.lit(DIGITS), n + 1, F.lit(1))
    text = F.concat(F.when(q >= 10, F.concat(digit((q / 10).cast("int")), F.lit("拾"))).otherwise(""), F.when((q % 10 > 0) | (q == 0), digit(q % 10)).otherwise(""), F.lit("元整"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amount_of_capitals(text).alias("amount"))


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS key FROM orders""")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration's key: the digest of its JSON with sorted names."""
    config = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(config), 256).alias("key"))


_SAID = "(SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[ \\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents))"


@query(f"WITH x AS (SELECT doc_id, i, regexp_matches(w, '^[0-9][0-9.,]*$') AS number, last_value(CASE WHEN w IN ('the', 'le', 'la', 'der', 'el') THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS before, first_value(CASE WHEN w IN ('the', 'le', 'la', 'der', 'el') THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM {_SAID}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS at, CAST(least(i - before, after - i) AS INTEGER) AS distance FROM x WHERE number")
def keyword_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each number is from the nearest keyword; null if the text has none."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[ \\n]+", " "), " "), lambda x: x != "")
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("at", "w"))
    key = F.when(F.col("w").isin("the", "le", "la", "der", "el"), F.col("at"))
    w = w.where(key.isNotNull() | F.col("w").rlike("^[0-9][0-9.,]*$"))
    by = Window.partitionBy("doc_id").orderBy("at")
    before = F.last(key, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(key, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    x = w.select("doc_id", "at", "w", F.least(F.col("at") - before, after - F.col("at")).alias("distance"))
    return x.where(F.col("w").rlike("^[0-9][0-9.,]*$")).select("doc_id", "at", "distance")
