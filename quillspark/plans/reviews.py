"""Reviews: rules over a tender's text, price and date checks of parties, suppression, manual overrides, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.strings import DIGITS, amount_of_capitals
from quillspark.operators.aggregates import worst
from quillspark.plans.registry import query, table

#: Words that say what an amount is, in the order in which they decide.
KINDS = {"security": "保证金", "performance": "履约担保", "limit": "最高限价|控制价|限价", "budget": "预算|采购金额"}
#: What sets off a payment.
TRIGGERS = {"advance": "预付", "delivery": "到货|交货", "acceptance": "验收", "warranty": "质保"}
TOLERANCE, MOST_SECURITY = 0.01, 0.02
CAPITALS = f"[{DIGITS}拾佰仟万亿]+[元圆园][{DIGITS}角分整正]*"
AMOUNT = "[0-9][0-9,]*(?:[.][0-9]+)?[ \\t]*(?:亿元|万元|元)"


def yuan(said: Column) -> Column:
    """A matched amount as a number of yuan."""
    n = F.regexp_replace(F.regexp_extract(said, "[0-9][0-9,]*(?:[.][0-9]+)?", 0), ",", "").try_cast("double")
    return F.when(said.rlike("^[0-9]"), n * F.when(said.contains("亿元"), 1e8).when(said.contains("万元"), 1e4).otherwise(1.0)).otherwise(amount_of_capitals(said))


def clauses(sections: DataFrame) -> DataFrame:
    """(doc_id, category, text) to doc_id, category, clause."""
    c = sections.select("doc_id", "category", F.explode(F.split("text", "[，。；;\\n]")).alias("clause"))
    return c.where("clause <> ''")


def amounts(sections: DataFrame) -> DataFrame:
    """doc_id, category, kind, amount: each amount of a clause that says what it is. An amount derived in another clause is of no
    kind and no candidate."""
    c = clauses(sections)
    kind = F.lit(None).cast("string")
    for name, words in reversed(KINDS.items()):
        kind = F.when(F.col("clause").rlike(words), name).otherwise(kind)
    said = F.concat(*[F.regexp_extract_all("clause", F.lit(p), F.lit(0)) for p in (AMOUNT, CAPITALS)])
    c = c.withColumn("kind", kind).where("kind is not null").select("doc_id", "category", "kind", F.explode(said).alias("said"))
    return c.select("doc_id", "category", "kind", F.round(yuan(F.col("said")), 2).alias("amount")).where("amount is not null")


def _money_checks(sections: DataFrame) -> DataFrame:
    """budget_vs_limit, limit_consistency and security_ratio, a row for each document of each."""
    top = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("amount"))).alias(kind)
    a = amounts(sections).groupBy("doc_id").agg(top("budget"), top("limit"), top("security"), F.countDistinct(F.when(F.col("kind") == "limit", F.col("amount"))).alias("limits"))
    said = clauses(sections).groupBy("doc_id").agg(
        F.bool_or(F.col("clause").rlike("标段|分包")).alias("lots"),
        F.bool_or(F.col("clause").rlike("(?:■|☑)[ ]*(?:不要求|无需|免收)") | (F.col("clause").rlike("保证金") & F.col("clause").rlike("^[^■☑□]*(?:不要求|无需|免收)"))).alias("waived"),
        F.max(F.when(F.col("clause").contains("保证金"), F.regexp_extract("clause", "([0-9]+(?:[.][0-9]+)?)[%％]", 1).try_cast("double"))).alias("percent"),
    )
    d = said.alias("s").join(a.alias("a"), F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")), "left").select("s.*", "budget", "limit", "security", F.coalesce("limits", F.lit(0)).alias("limits"))
    budget, limit, share = F.col("budget"), F.col("limit"), F.coalesce(F.col("security") / F.coalesce("limit", "budget"), F.col("percent") / 100)
    first = F.when(budget.isNull() & limit.isNull(), "unclear").when(budget + TOLERANCE < limit, "fail").otherwise("pass")
    second = F.when(F.col("limits") == 0, "unclear").when(F.col("limits") == 1, "pass").when(F.col("lots"), "unclear").otherwise("fail")
    third = F.when(F.col("waived"), "pass").when(share.isNull(), "unclear").when(share <= MOST_SECURITY + 1e-9, "pass").otherwise("fail")
    rows = F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in (("budget_vs_limit", first), ("limit_consistency", second), ("security_ratio", third))])
    return d.select("doc_id", F.inline(rows))


def _signature_check(sections: DataFrame, check: str, about: str, sign: Column) -> DataFrame:
    """pass if all categories that speak of it say the same, fail if they differ, unclear if fewer than two do."""
    c = clauses(sections).where(F.col("clause").rlike(about)).select("doc_id", "category", sign.alias("sign")).where("sign <> ''")
    per = c.groupBy("doc_id", "category").agg(F.array_join(F.array_sort(F.collect_set("sign")), ";").alias("sign"))
    said = per.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("sign").alias("kinds")).alias("p")
    d = sections.select("doc_id").distinct().alias("d").join(said, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    return d.select("d.doc_id", F.lit(check).alias("check"), F.when(F.coalesce("n", F.lit(0)) < 2, "unclear").when(F.col("kinds") == 1, "pass").otherwise("fail").alias("status"))


def _stage() -> Column:
    """trigger:percent:days of a clause about a payment, empty if it names no percentage."""
    trigger = F.lit("other")
    for name, words in reversed(TRIGGERS.items()):
        trigger = F.when(F.col("clause").rlike(words), name).otherwise(trigger)
    percent = F.regexp_extract("clause", "([0-9]+(?:[.][0-9]+)?)[%％]", 1)
    return F.when(percent != "", F.concat_ws(":", trigger, percent, F.regexp_extract("clause", "([0-9]+)个?(?:工作日|日|天)", 1))).otherwise("")


def _score_check(sections: DataFrame) -> DataFrame:
    """Whether the categories' points add up to the stated total."""
    of = lambda words: F.aggregate(F.regexp_extract_all("clause", F.lit(f"(?:{words})[^0-9]{{0,6}}([0-9]+(?:[.][0-9]+)?)分"), F.lit(1)), F.lit(None).cast("double"), lambda a, x: F.coalesce(a, F.lit(0.0)) + x.cast("double"))
    s = clauses(sections).groupBy("doc_id").agg(F.sum(of("商务|技术|价格|报价")).alias("parts"), F.max(of("总分|满分|合计")).alias("whole"))
    return s.select("doc_id", F.lit("evaluation_points").alias("check"), F.when(F.col("parts").isNull() | F.col("whole").isNull(), "unclear").when(F.abs(F.col("parts") - F.col("whole")) <= TOLERANCE, "pass").otherwise("fail").alias("status"))


def tender_checks(sections: DataFrame) -> DataFrame:
    """(doc_id, category, text, ...) to doc_id, check, status (pass, fail, unclear): six checks of each document that has any text.

    Null and empty texts say nothing; null doc_ids are one document and null categories one category. Other columns are
    ignored; an empty table gives an empty result.
    """
    s = sections.where("text is not null").select("doc_id", "category", "text")
    s = s.where(F.regexp_replace("text", "[，。；;\\n]", "") != "")
    amount = F.concat_ws(",", F.regexp_extract_all("clause", F.lit("[0-9]+(?:[.][0-9]+)?[%％]|" + AMOUNT), F.lit(0)))
    out = _money_checks(s).union(_signature_check(s, "performance_consistency", "履约", amount))
    return out.union(_signature_check(s, "payment_consistency", "支付|付款|预付", _stage())).union(_score_check(s))


def verdicts(checks: DataFrame, by: list[str]) -> DataFrame:
    """Statuses folded to the worst of each party."""
    return checks.groupBy(*by).agg(F.count("*").alias("checks"), worst(F.col("status")).alias("verdict"))


@query()
def tender_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), "text")
    return verdicts(tender_checks(d), ["doc_id"])


_ITEMS = "SELECT l_orderkey, count(*) AS n, count(*) FILTER (abs(l_quantity * p_retailprice - l_extendedprice) > 0.1) AS wrong, count(*) FILTER (p_retailprice IS NULL) AS open, count(*) - count(DISTINCT l_partkey) AS repeated FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 2 GROUP BY 1"


@query(f"SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN repeated > 0 OR wrong > 0 THEN 'fail' WHEN open > 0 THEN 'unclear' ELSE 'pass' END AS status FROM orders LEFT JOIN ({_ITEMS}) ON o_orderkey = l_orderkey")
def itemized_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity times unit price against each line's total, within 0.10; repeated items fail, a line without a unit price is
    unresolved, a party without lines is missing."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 2")
    wrong = F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")) > 0.1
    g = l.join(p, l.l_partkey == p.p_partkey, "left").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("p_retailprice").isNull()).alias("open"), (F.count("*") - F.countDistinct("l_partkey")).alias("repeated"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("n").isNull(), "missing").when((F.col("repeated") > 0) | (F.col("wrong") > 0), "fail").when(F.col("open") > 0, "unclear").otherwise("pass").alias("status"))


_LIMITS = "SELECT o_orderpriority AS p, avg(o_totalprice) * 1.5 AS most FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"


@query(f"SELECT o_orderkey, CASE WHEN o_totalprice <= most + 0.01 THEN 'pass' ELSE 'fail' END AS status FROM orders JOIN ({_LIMITS}) ON o_orderpriority = p")
def price_limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A party's price against its tender's limit."""
    o = table(spark, sf_dir, "orders")
    limit = o.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg((F.avg("o_totalprice") * 1.5).alias("most"))
    return o.join(limit, "o_orderpriority").select("o_orderkey", F.when(F.col("o_totalprice") <= F.col("most") + TOLERANCE, "pass").otherwise("fail").alias("status"))


@query("SELECT o_orderkey, CASE WHEN max(l_shipdate) IS NULL THEN 'missing' WHEN max(l_shipdate) > o_orderdate + INTERVAL 120 DAY THEN 'fail' ELSE 'pass' END AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate")
def deadline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of a party's dates against its deadline; none is missing."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("last").isNull(), "missing").when(F.col("last") > F.expr("o_orderdate + interval 120 day"), "fail").otherwise("pass").alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN s.s_suppkey IS NULL THEN 'kept' ELSE 'skipped: reported missing' END AS decision FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000) s ON l_suppkey = s.s_suppkey")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about what another check has reported missing are set aside, with the reason."""
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select("s_suppkey")
    f = table(spark, sf_dir, "lineitem").join(gone, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return f.select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("s_suppkey").isNull(), "kept").otherwise("skipped: reported missing").alias("decision"))


@query("SELECT d.doc_id, CASE WHEN coalesce(l.quality * 1000, n_chars) >= 500 THEN 'pass' ELSE 'fail' END AS status, l.quality IS NOT NULL AS by_hand FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def manual_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule evaluated again with the values that were set by hand."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars").alias("d"), table(spark, sf_dir, "labels").alias("l")
    j = d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return j.select("d.doc_id", F.when(F.coalesce(F.col("quality") * 1000, F.col("n_chars")) >= 500, "pass").otherwise("fail").alias("status"), F.col("quality").isNotNull().alias("by_hand"))


_CHECKS = f"SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN repeated > 0 OR wrong > 0 THEN 'fail' WHEN open > 0 THEN 'unclear' ELSE 'pass' END AS s FROM orders LEFT JOIN ({_ITEMS}) ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, CASE WHEN o_totalprice <= most + 0.01 THEN 'pass' ELSE 'fail' END FROM orders JOIN ({_LIMITS}) ON o_orderpriority = p UNION ALL SELECT o_orderkey, CASE WHEN max(l_shipdate) IS NULL THEN 'missing' WHEN max(l_shipdate) > o_orderdate + INTERVAL 120 DAY THEN 'fail' ELSE 'pass' END FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate"


@query(f"SELECT o_orderkey, count(*) AS checks, CASE max(CASE s WHEN 'fail' THEN 3 WHEN 'missing' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'missing' WHEN 1 THEN 'unclear' ELSE 'pass' END AS verdict FROM ({_CHECKS}) GROUP BY 1")
def party_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a party and the worst of them."""
    checks = itemized_check(spark, sf_dir).unionByName(price_limit_check(spark, sf_dir)).unionByName(deadline_check(spark, sf_dir))
    return verdicts(checks, ["o_orderkey"])
