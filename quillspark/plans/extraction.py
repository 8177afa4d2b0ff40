"""What is read out of lines of text: amounts and percentages with their places, rows that multiply, pages, scores, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.strings import PUNCTUATION, containment
from quillspark.operators.matching import ratio
from quillspark.plans.reviews import AMOUNT, CAPITALS, yuan
from quillspark.plans.registry import query, table

#: Digits of Chinese numbers.
NUMERALS = "零一二三四五六七八九"
PERCENT = f"[0-9]+(?:[.][0-9]+)?[ ]*[%％]|百分之[{NUMERALS}十点]+"
_NUM = "([0-9]+(?:[.][0-9]+)?)"
#: What price times quantity may differ from a total, and the largest quantity.
OFF, MOST_PIECES = 0.1, 100_000
#: Weights of words around a candidate for a price limit: strong, medium, weak, and those that speak against it.
LIMIT_WORDS = (("small", 120), ("red", 60), ("ring", 12), ("large", -45))


def places(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text in order, as structs (start, end, said); starts count from 0, ends are exclusive. A
    null text gives null, one without a match an empty list."""
    said = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    kind = "array<struct<start:int,end:int,said:string>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.char_length(x["said"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["said"].alias("said"))).alias("out"))

    each = F.filter(F.transform(F.arrays_zip(gaps.alias("gap"), said.alias("said")), lambda x: F.struct(x["gap"].alias("gap"), x["said"].alias("said"))), lambda x: x["said"].isNotNull())
    return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])


def percentage(said: Column) -> Column:
    """A matched percentage as a number, written in digits or in words (up to ninety-nine, with decimals)."""
    words = F.regexp_extract(said, "百分之(.*)", 1)
    digits = lambda c: F.translate(c, NUMERALS, "0123456789")
    whole, part = F.split_part(words, F.lit("点"), F.lit(1)), F.split_part(words, F.lit("点"), F.lit(2))
    tens, ones = F.split_part(whole, F.lit("十"), F.lit(1)), F.split_part(whole, F.lit("十"), F.lit(2))
    or_else = lambda c, x: F.when(c == "", x).otherwise(digits(c))
    n = F.when(whole.contains("十"), F.concat(or_else(tens, F.lit("1")), or_else(ones, F.lit("0")))).otherwise(digits(whole))
    return F.when(words == "", F.regexp_extract(said, _NUM, 1).try_cast("double")).otherwise(F.concat(n, F.lit("."), or_else(part, F.lit("0"))).try_cast("double"))


@query("SELECT o_orderkey, CAST(length(h) AS INTEGER) AS start, CAST(length(h || s) + 1 AS INTEGER) AS end, o_totalprice AS amount FROM (SELECT *, 'total ¥' AS h, format('{:,.2f}', o_totalprice) AS s FROM orders) UNION ALL SELECT o_orderkey, CAST(length(h) AS INTEGER), CAST(length(h || o_orderkey % 97) + 2 AS INTEGER), (o_orderkey % 97) * 10000.0::DOUBLE FROM (SELECT *, 'total ¥' || format('{:,.2f}', o_totalprice) || '元, deposit ' AS h FROM orders)")
def money_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a text with their places, in digits with units or in capitals."""
    text = F.concat(F.lit("total ¥"), F.format_number("o_totalprice", 2), F.lit("元, deposit "), F.col("o_orderkey") % 97, F.lit("万元"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(places(text, f"{AMOUNT}|{CAPITALS}")))
    return found.select("o_orderkey", "start", "end", F.round(yuan(F.col("said")), 2).alias("amount"))


@query("SELECT l_orderkey, l_partkey, round(l_discount * 100)::DOUBLE AS percent FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 10.5 FROM lineitem")
def percent_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of a text, in digits or in words."""
    word = F.element_at(F.array(*[F.lit(c) for c in NUMERALS[1:]]), F.col("l_linenumber"))
    text = F.concat(F.lit("rate "), F.round(F.col("l_discount") * 100).cast("int"), F.lit("% 上浮百分之十"), word, F.lit("点五"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.inline(places(text, PERCENT))).select("l_orderkey", "l_partkey", percentage(F.col("said")).alias("percent"))


def product_row(line: Column) -> Column:
    """The last three numbers in a row of a line, as price, pieces, total: (price, pieces, total, fits), the pieces being the
    second number, or the first where only that one can be a count; null if there are no three."""
    g = lambda i: F.regexp_extract(line, f"^.*(?:^|[ ]){_NUM}[ ]+{_NUM}[ ]+{_NUM}", i).try_cast("double")
    a, b, total = g(1), g(2), g(3)
    count = lambda n: (n > 0) & (n <= MOST_PIECES)
    swap = count(a) & ~count(b)
    row = F.struct(F.when(swap, b).otherwise(a).alias("price"), F.when(swap, a).otherwise(b).alias("pieces"), total.alias("total"), (F.abs(a * b - total) <= OFF).alias("fits"))
    return F.when(total.isNotNull() & (count(a) | count(b)), row)


@query("SELECT l_orderkey, l_partkey, (l_partkey + 1)::DOUBLE AS price, l_quantity AS pieces, (l_partkey + 1) * l_quantity + l_linenumber % 2 AS total, l_linenumber % 2 = 0 AS fits FROM lineitem")
def row_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, pieces = F.col("l_partkey") + 1, F.col("l_quantity").cast("bigint")
    line = F.concat_ws(" ", F.lit("3 item"), price, pieces, price * pieces + F.col("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", product_row(line).alias("x")).select("l_orderkey", "l_partkey", "x.*")


def pages_of(json: Column) -> Column:
    """The pages that a JSON text names, at any depth, each once, ascending; a null text gives null."""
    found = F.regexp_extract_all(json, F.lit("\"page(?:_no|_number)?\"[ ]*:[ ]*([0-9]{1,9})(?![0-9.])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = l_quantity THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(least(l_linenumber, l_quantity) AS INTEGER) || ',' || CAST(greatest(l_linenumber, l_quantity) AS INTEGER) END AS pages FROM lineitem")
def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.to_json(F.struct(F.col("l_linenumber").alias("page"), F.struct(F.col("l_quantity").cast("int").alias("page_no"), F.col("l_tax").alias("pages")).alias("inner")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.array_join(pages_of(json).cast("array<string>"), ",").alias("pages"))


def slug(name: Column) -> Column:
    """A name as part of a key: lower-case letters and digits of ASCII, hyphens for all else, `unnamed` if none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", "unnamed").otherwise(s)


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT p_partkey, 'projects/' || {_SLUG.format('p_brand')} || '/' || {_SLUG.format('p_name')} || '/' || left(sha256(p_brand || p_name), 12) AS key FROM part")
def object_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.left(F.sha2(F.concat("p_brand", "p_name"), 256), F.lit(12))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.lit("projects"), slug(F.col("p_brand")), slug(F.col("p_name")), digest).alias("key"))


def requirement_key(text: Column) -> Column:
    """The key by which requirements and responses meet: no marks, signs of measures as letters, no punctuation or blanks, lower case."""
    t = F.translate(F.regexp_replace(text, "[★△▲●*]", ""), "℃×", "cx")
    return F.lower(F.regexp_replace(F.regexp_replace(t, PUNCTUATION, ""), "[ \\t\\r\\n]+", ""))


_REQUIREMENT = "lower(regexp_replace(regexp_replace(translate(regexp_replace(text, '[★△▲●*]', '', 'g'), '℃×', 'cx'), '" + PUNCTUATION.replace("'", "''") + "', '', 'g'), '[ \\t\\r\\n]+', '', 'g'))"


@query(f"SELECT doc_id, sha256({_REQUIREMENT}) AS key FROM documents")
def deviation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(requirement_key(F.col("text")), 256).alias("key"))


@query("SELECT p_brand, first(p_partkey ORDER BY s DESC, p_retailprice DESC, p_partkey) AS p_partkey, max(s) AS score FROM (SELECT *, CASE WHEN contains(p_name, 'small') THEN 120 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 60 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 12 ELSE 0 END - CASE WHEN contains(p_name, 'large') THEN 45 ELSE 0 END AS s FROM part) GROUP BY 1")
def limit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of a group by the words around it, the larger amount in a tie."""
    score = sum((F.when(F.col("p_name").contains(w), n).otherwise(0) for w, n in LIMIT_WORDS), F.lit(0))
    p = table(spark, sf_dir, "part").withColumn("s", score)
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("s"), -F.col("p_retailprice"), "p_partkey")).alias("p_partkey"), F.max("s").alias("score"))


@query("SELECT l_orderkey, l_partkey, least(0.45::DOUBLE * (l_discount * 10) + 0.35::DOUBLE * (l_tax * 10) + 0.2::DOUBLE * (l_quantity / 50), 0.9999::DOUBLE) AS score FROM lineitem")
def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of similar sections, blocks and tables as one score, below one."""
    s = 0.45 * (F.col("l_discount") * 10) + 0.35 * (F.col("l_tax") * 10) + 0.2 * (F.col("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.least(s, F.lit(0.9999)).alias("score"))


def label_score(a: Column, b: Column) -> Column:
    """How alike two labels are: 1 if equal; at least 0.78 if one of four characters and more is part of the other; else
    their ratio. Empty and null labels are like nothing."""
    part = (F.least(F.char_length(a), F.char_length(b)) >= 4) & (a.contains(b) | b.contains(a))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).when(part, F.greatest(F.lit(0.78), containment(a, b))).otherwise(ratio(a, b))


def party_score(said: Column, party: Column) -> Column:
    """How well a text names a party: the better of ratio and share of the party's characters, and more if one holds the
    other, 1 at most. Empty and null texts name nobody."""
    letters = lambda c: F.array_distinct(F.split(c, ""))
    share = F.size(F.array_intersect(letters(said), letters(party))) / F.size(letters(party))
    holds = F.when(said.contains(party) | party.contains(said), 0.35).otherwise(0.0)
    empty = (F.coalesce(said, F.lit("")) == "") | (F.coalesce(party, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(F.least(F.greatest(ratio(said, party), share) + holds, F.lit(1.0)))


@query()
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different name of a type of part against the type, as a label and as a party."""
    p = table(spark, sf_dir, "part").select("p_name", F.lower("p_type").alias("p_type")).distinct()
    return p.select("p_name", "p_type", label_score(F.col("p_name"), F.col("p_type")).alias("label"), party_score(F.col("p_name"), F.col("p_type")).alias("party"))
