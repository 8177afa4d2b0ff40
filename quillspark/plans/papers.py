"""Further steps over bid documents: templates and their slots, requirements and answers, seals and dates, layout, lines, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.strings import amount_of_capitals
from quillspark.functions.text import bigrams
from quillspark.operators.aggregates import worst
from quillspark.operators.matching import ratio
from quillspark.plans.bids import NAMED, company_score, compact, rows
from quillspark.plans.pricing import events_of
from quillspark.plans.registry import query, table
from quillspark.plans.reviews import tender_checks

#: Ratio from which an item stands in a line; below the second a long one is missing; characters of a long item and line.
STANDS, ABSENT, LONG_ITEM, LONG_LINE = 0.93, 0.30, 12, 24
#: What answers score: for each fragment of the requirement (three at most), for holding it whole; and what suffices.
FRAGMENT, WHOLE, ENOUGH = 0.22, 0.45, 0.68
#: From which similarity of names a rule is taken for another's.
NAMED_ALIKE = 0.35
#: Names of slots that a person fills.
SLOT = "_{2,}|…{2,}"

_DECLARED = "(VALUES (1, 1, '小写：1,200,000.00元 大写：壹佰贰拾万元整'), (2, 1, '小写：300元'), (2, 2, '叁佰零壹元整'), (3, 1, '小写：5元'), (4, 1, '无')) AS t(doc, i, line)"


@query("SELECT * FROM (VALUES (1, 'pass'), (2, 'fail'), (3, 'missing'), (4, 'missing')) AS t(doc, status)")
def price_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the amounts in figures and in capitals that stand together are the same; without such a pair, missing."""
    lines, w = rows(spark, _DECLARED), Window.partitionBy("doc").orderBy("i")
    e = events_of(lines).withColumn("small", F.coalesce("small", F.when(F.lag("capital").over(w).isNull(), F.lag("small").over(w)))).where("capital is not null and small is not null")
    same = F.abs(F.regexp_replace("small", "[,，]", "").cast("double") - amount_of_capitals(F.col("capital"))) < 0.01
    said = e.groupBy("doc").agg(F.bool_and(same).alias("same"))
    d = lines.select("doc").distinct().join(said, "doc", "left")
    return d.select("doc", F.when(F.col("same").isNull(), "missing").when(F.col("same"), "pass").otherwise("fail").alias("status"))


_LIMITS = "(VALUES (1, '监理', '>=', 10.0), (1, '施工图审查', '>=', 5.0), (1, 'generic', '>', 1.5), (2, 'generic', '<=', 95.0)) AS r(doc, name, op, threshold)"
_RATES = "(VALUES (1, 1, '监理', 12.0), (2, 1, '施工图审', 4.0), (3, 1, '造价咨询', 1.5), (4, 2, '全部', 95.0), (5, 3, '全部', 9.0)) AS b(id, doc, name, rate)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substring({0}, i, 2)))"
_NEAR = f"len(list_intersect({_GRAMS.format('b.name')}, {_GRAMS.format('r.name')}))::DOUBLE / len(list_distinct(list_concat({_GRAMS.format('b.name')}, {_GRAMS.format('r.name')})))"
_HOLDS = "CASE op WHEN '>' THEN rate > threshold WHEN '>=' THEN rate >= threshold WHEN '<' THEN rate < threshold WHEN '<=' THEN rate <= threshold END"


@query(f"WITH p AS (SELECT b.id, b.rate, r.name AS rule, r.op, r.threshold, CASE WHEN b.name = r.name THEN 2.0 WHEN r.name = 'generic' THEN 0.0 ELSE {_NEAR} END AS s FROM {_RATES} LEFT JOIN {_LIMITS} ON b.doc = r.doc), m AS (SELECT id, any_value(rate) AS rate, arg_max({{'rule': rule, 'op': op, 'threshold': threshold}}, s) FILTER (s >= {NAMED_ALIKE} OR rule = 'generic') AS x FROM p GROUP BY id), y AS (SELECT id, rate, x.rule AS rule, x.op AS op, x.threshold AS threshold FROM m) SELECT id, rule, CASE WHEN rule IS NULL THEN 'unclear' WHEN {_HOLDS} THEN 'pass' ELSE 'fail' END AS status FROM y")
def rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offered rate against the rule of its name, else of the name most alike, else the general one; rules and rates meet
    within a document."""
    b = rows(spark, _RATES)
    r = rows(spark, _LIMITS).select("doc", F.col("name").alias("rule"), "op", "threshold")
    a, c = bigrams(F.col("name")), bigrams(F.col("rule"))
    near = F.size(F.array_intersect(a, c)) / F.size(F.array_union(a, c))
    p = b.join(r, "doc", "left").withColumn("s", F.when(F.col("name") == F.col("rule"), 2.0).when(F.col("rule") == "generic", 0.0).otherwise(near))
    fits = (F.col("s") >= NAMED_ALIKE) | (F.col("rule") == "generic")
    m = p.groupBy("id").agg(F.max("rate").alias("rate"), F.max_by(F.struct("rule", "op", "threshold"), F.when(fits, F.col("s"))).alias("x")).withColumn("x", F.when(F.col("x.rule").isNotNull(), F.col("x"))).select("id", "rate", "x.*")
    holds = F.lit(False)
    for sign, cond in ((">", F.col("rate") > F.col("threshold")), (">=", F.col("rate") >= F.col("threshold")), ("<", F.col("rate") < F.col("threshold")), ("<=", F.col("rate") <= F.col("threshold"))):
        holds = F.when(F.col("op") == sign, cond).otherwise(holds)
    return m.select("id", "rule", F.when(F.col("rule").isNull(), "unclear").when(holds, "pass").otherwise("fail").alias("status"))


_ITEMS = "(VALUES (1, '1', '本公司承诺遵守招标文件的全部规定'), (2, '1', '授权代表全权处理投标事宜并签署文件'), (3, '1', '投标有效期为九十天'), (4, '2', '短句'), (5, '3', '没有对应章节的条款')) AS i(id, no, ref)"
_BODY = "(VALUES ('1', '致招标人：本公司承诺遵守招标文件的全部规定，特此声明'), ('1', '投标有效期为90天'), ('1', 'completely unrelated words in another language stand here'), ('2', '别的')) AS b(no, line)"


@query("SELECT * FROM (VALUES (1, 'pass'), (2, 'missing'), (3, 'unclear'), (4, 'unclear'), (5, 'missing')) AS t(id, status)")
def template_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a template in the bid's section of its number: held or nearly so, pass; a long one that no long line comes near,
    missing, as is one without a section; else unclear."""
    j = rows(spark, _ITEMS).join(rows(spark, _BODY), "no", "left")
    held = F.coalesce(compact(F.col("line")).contains(compact(F.col("ref"))), F.lit(False))
    score = F.when(F.col("line").isNotNull(), ratio("ref", "line"))
    per = j.groupBy("id").agg(F.bool_or(held).alias("held"), F.max(score).alias("best"), F.max(F.char_length("ref")).alias("n"), F.max(F.char_length("line")).alias("m"))
    absent = F.col("best").isNull() | ((F.col("n") >= LONG_ITEM) & (F.col("m") >= LONG_LINE) & (F.col("best") < ABSENT))
    return per.select("id", F.when(F.col("held") | (F.col("best") >= STANDS), "pass").when(absent, "missing").otherwise("unclear").alias("status"))


_LINES = "(VALUES (1, '致：________（招标人）'), (2, '投标有效期____天'), (3, '没有空格'), (4, '地址：……')) AS t(id, line)"
_FILLED = "(VALUES ('致：某某中心（招标人）'), ('投标有效期____天'), ('地址：')) AS b(said)"


@query("SELECT * FROM (VALUES (1, true, true), (2, true, false), (4, false, false)) AS t(id, found, filled)")
def slot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a template with slots: whether the bid has the line, and with something in its slots. Templates are few and
    broadcast."""
    t = rows(spark, _LINES).where(F.col("line").rlike(SLOT)).withColumn("rx", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("line", "([.?*+(){}\\[\\]|^$\\\\])", "\\\\$1"), SLOT, "(.+)"), F.lit("$")))
    j = rows(spark, _FILLED).join(F.broadcast(t), F.expr("said rlike rx")).select("id", F.expr("regexp_extract(said, rx, 1)").alias("value"))
    found = j.groupBy("id").agg(F.bool_or(~F.col("value").rlike("^(?:_|…| )*$")).alias("filled"))
    return t.select("id").join(found, "id", "left").select("id", F.col("filled").isNotNull().alias("found"), F.coalesce("filled", F.lit(False)).alias("filled"))


_SIGNED = "(VALUES ('甲', '甲科技公司', '甲科技公司', 2, 2, DATE '2024-05-01'), ('乙', '乙集团', '某某印章', 1, 2, DATE '2024-05-03'), ('丙', '丙公司', NULL, 2, 2, NULL)) AS t(party, name, seal, signed, needed, day)"


@query("SELECT * FROM (VALUES ('甲', 'pass', 'pass', 'pass', 'pass'), ('乙', 'fail', 'fail', 'fail', 'fail'), ('丙', 'missing', 'pass', 'missing', 'missing')) AS t(party, seal, signature, date, verdict)")
def seal_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A party's seal names it, it has signed wherever it must, and no later than the deadline (2 May 2024 here)."""
    s = rows(spark, _SIGNED).withColumn("score", company_score(F.col("name"), F.col("seal")))
    seal = F.when(F.col("seal").isNull(), "missing").when(F.col("score") >= NAMED, "pass").otherwise("fail")
    sign = F.when(F.col("signed") >= F.col("needed"), "pass").otherwise("fail")
    date = F.when(F.col("day").isNull(), "missing").when(F.col("day") <= F.lit("2024-05-02").cast("date"), "pass").otherwise("fail")
    s = s.select("party", seal.alias("seal"), sign.alias("signature"), date.alias("date"))
    one = s.select("party", F.explode(F.array("seal", "signature", "date")).alias("status")).groupBy("party").agg(worst(F.col("status")).alias("verdict"))
    return s.join(one, "party")


_ASKED = "(VALUES (1, '质保期不少于三年', '质保期|三年'), (2, '交货期30天', '交货期|30天'), (3, '现场培训两次', '现场培训')) AS q(id, requirement, fragments)"
_REPLIES = "(VALUES (1, '质保期不少于三年，响应', 'none'), (2, '交货期45天', 'negative'), (3, '质保期五年', 'positive'), (4, '其他', 'none')) AS a(seq, line, class)"


@query("SELECT * FROM (VALUES (1, 1, 'none', true), (2, 2, 'negative', true), (3, NULL, NULL, false)) AS t(id, seq, class, found)")
def requirement_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that answers a requirement best, if it does well enough: by its ratio, the fragments it holds and whether it holds
    the requirement whole. Requirements are few and broadcast."""
    p = rows(spark, _REPLIES).join(F.broadcast(rows(spark, _ASKED)), F.lit(True))
    hits = F.size(F.filter(F.split("fragments", "[|]"), lambda x: F.col("line").contains(x)))
    score = ratio("requirement", "line") + FRAGMENT * F.least(hits, F.lit(3)) + F.when(F.col("line").contains(F.col("requirement")), WHOLE).otherwise(0.0)
    p = p.withColumn("score", score).where(F.col("score") >= ENOUGH).groupBy("id").agg(F.max_by(F.struct("seq", "class"), F.struct("score", -F.col("seq"))).alias("x"))
    return rows(spark, _ASKED).select("id").join(p, "id", "left").select("id", "x.seq", "x.class", F.col("x").isNotNull().alias("found"))


_LAYOUT = "(VALUES (1, 'text', 'b', 10.0, 50.0, 90.0, 60.0), (1, 'text', 'a', 10.0, 20.0, 90.0, 30.0), (1, 'text', 'a', 10.0, 20.0, 90.0, 30.0), (1, 'image', '', 0.0, 0.0, 5.0, 5.0), (2, 'seal', 's', 30.0, 40.0, 31.0, 41.0), (2, 'heading', '  ', 0.0, 0.0, 9.0, 9.0)) AS t(page, type, text, x0, y0, x1, y1)"


@query(f"WITH d AS (SELECT DISTINCT * FROM {_LAYOUT} WHERE type IN ('heading', 'text', 'table', 'seal', 'signature') AND (trim(text) <> '' OR type IN ('seal', 'signature'))) SELECT page, type, text, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, text) AS INTEGER) AS place FROM d")
def layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page in reading order, each once; blocks without text go, but for seals and signatures."""
    mark = F.col("type").isin("seal", "signature")
    d = rows(spark, _LAYOUT).where(mark | (F.col("type").isin("heading", "text", "table") & (F.trim("text") != ""))).distinct()
    return d.select("page", "type", "text", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "text")).alias("place"))


_WRAPPED = "(VALUES (1, 1, '1 水泵'), (1, 2, '不锈钢'), (1, 3, '2 阀门 10'), (1, 4, '3 管件'), (1, 5, '黄铜'), (1, 6, '标准'), (2, 1, '前言'), (2, 2, '1 x')) AS t(doc, i, line)"


@query(f"WITH g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]+[ 、.．]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS b FROM {_WRAPPED}) SELECT doc, CAST(b AS BIGINT) AS block, string_agg(line, ' ' ORDER BY i) AS said FROM g WHERE b > 0 GROUP BY 1, 2")
def row_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were wrapped over lines, put together: a line with a number opens a row, those after it belong to it."""
    starts = F.when(F.col("line").rlike("^[0-9]+[ 、.．]"), 1).otherwise(0)
    g = rows(spark, _WRAPPED).withColumn("block", F.sum(starts).over(Window.partitionBy("doc").orderBy("i"))).where("block > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ")  # the lines of one row
    return g.groupBy("doc", "block").agg(said.alias("said"))


@query(f"WITH a AS (SELECT doc, i FROM {_WRAPPED} WHERE contains(line, '1 ')) SELECT doc, a.i AS anchor, t.i AS line FROM {_WRAPPED} JOIN a USING (doc) WHERE t.i BETWEEN a.i AND a.i + 2")
def anchored_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines from an anchor on, as far as a window reaches: an anchor names the few lines that it takes, no range is tried."""
    t = rows(spark, _WRAPPED)
    a = t.where(F.col("line").contains("1 ")).select("doc", F.col("i").alias("anchor"), F.explode(F.sequence("i", F.col("i") + 2)).alias("i"))
    return t.join(a, ["doc", "i"]).select("doc", "anchor", F.col("i").alias("line"))


_LOTS = "(VALUES (1, '一、水泵 费率 5.5%'), (2, '(2) 阀门安装费 3%'), (3, '3.本条款自签订之日起生效'), (4, '说明'), (5, NULL)) AS t(id, line)"
_NUMBERED = "^[(（]?([0-9]+|[一二三四五六七八九十]+)[)）、.．] *(.*)$"


@query(f"SELECT id, regexp_extract(line, '{_NUMBERED}', 1) AS serial, trim(regexp_replace(regexp_extract(line, '{_NUMBERED}', 2), '(费率)? *[0-9.]+%$', '')) AS label, TRY_CAST(nullif(regexp_extract(line, '([0-9.]+)%', 1), '') AS DOUBLE) AS rate FROM {_LOTS} WHERE regexp_matches(line, '{_NUMBERED}') AND NOT regexp_matches(line, '条款|生效|应当')")
def rate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items with their labels and rates; what reads like a clause is none."""
    t = rows(spark, _LOTS).where(F.col("line").rlike(_NUMBERED) & ~F.col("line").rlike("条款|生效|应当"))
    label = F.trim(F.regexp_replace(F.regexp_extract("line", _NUMBERED, 2), "(费率)? *[0-9.]+%$", ""))
    return t.select("id", F.regexp_extract("line", _NUMBERED, 1).alias("serial"), label.alias("label"), F.nullif(F.regexp_extract("line", "([0-9.]+)%", 1), F.lit("")).cast("double").alias("rate"))


_PARTS = "(VALUES (1, 1, 'h1', 3, 3), (1, 2, 'h1', 4, 5), (1, 3, 'h2', 6, 6), (1, 4, 'h1', 7, 7), (1, 5, 'h1', 9, 9)) AS t(doc, seq, head, first, last)"


@query(f"WITH s AS (SELECT *, CASE WHEN head = lag(head) OVER w AND first - lag(last) OVER w <= 1 THEN 0 ELSE 1 END AS starts FROM {_PARTS} WINDOW w AS (PARTITION BY doc ORDER BY seq)), g AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY seq) AS run FROM s) SELECT doc, CAST(run AS BIGINT) AS run, count(*) AS parts, min(first) AS first, max(last) AS last FROM g GROUP BY 1, 2")
def table_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on: the same head, on the next page at most."""
    w = Window.partitionBy("doc").orderBy("seq")
    goes_on = (F.col("head") == F.lag("head").over(w)) & (F.col("first") - F.lag("last").over(w) <= 1)
    g = rows(spark, _PARTS).withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("starts").over(w))
    return g.groupBy("doc", "run").agg(F.count("*").alias("parts"), F.min("first").alias("first"), F.max("last").alias("last"))


_OFFERED = "(VALUES (1, '水泵', 100.0), (2, 'a', 5.0), (2, 'b', 6.0), (3, NULL, NULL)) AS i(doc, label, amount)"
_STATED = "(VALUES (2, 11.0)) AS s(doc, total)"


@query(f"SELECT doc, amount AS total, 'inferred' AS source FROM (SELECT doc, max(amount) AS amount, count(*) AS n FROM {_OFFERED} GROUP BY doc) WHERE n = 1 AND amount IS NOT NULL AND doc NOT IN (SELECT doc FROM {_STATED}) UNION ALL SELECT doc, total, 'stated' FROM {_STATED}")
def implied_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as stated; where none is and there is one item only, its amount."""
    stated = rows(spark, _STATED)
    one = rows(spark, _OFFERED).groupBy("doc").agg(F.max("amount").alias("total"), F.count("*").alias("n")).where("n = 1 and total is not null").join(stated.select("doc"), "doc", "left_anti")
    return one.select("doc", "total", F.lit("inferred").alias("source")).union(stated.select("doc", "total", F.lit("stated")))


_RAW = "(VALUES ('甲', 'price', '合格', 0, 0), ('甲', 'integrity', NULL, 2, 1), ('甲', 'deviation', NULL, 0, 0), ('乙', 'price', '不合格', 0, 0), ('乙', 'seal', '待确认', 0, 0), ('乙', 'integrity', NULL, 0, 3)) AS t(party, check_code, said, failed, missing)"


@query(f"SELECT party, check_code, CASE WHEN said IN ('不合格', '不通过', 'fail') OR failed > 0 THEN 'fail' WHEN missing > 0 THEN 'missing' WHEN said IN ('合格', '通过', 'pass') OR said IS NULL THEN 'pass' ELSE 'unclear' END AS status, failed + missing AS issues FROM {_RAW}")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check says in its own words and counts, in the words of all."""
    said = F.col("said")
    status = F.when(said.isin("不合格", "不通过", "fail") | (F.col("failed") > 0), "fail").when(F.col("missing") > 0, "missing").when(said.isin("合格", "通过", "pass") | said.isNull(), "pass").otherwise("unclear")
    return rows(spark, _RAW).select("party", "check_code", status.alias("status"), (F.col("failed") + F.col("missing")).alias("issues"))


_BOUND = "(VALUES (1, 'p', 't', 'b1', 'x1'), (2, 'p', 't', 'b2', NULL)) AS r(id, project, tender, business, technical)"
_CHANGED = "(VALUES (1, 'p', 't', 'b2', NULL), (2, 'p', 't', 'b2', NULL), (2, 'p', 't', 'b3', 'x1')) AS c(id, project, tender, business, technical)"


@query(f"SELECT c.id, c.business, NOT EXISTS (SELECT 1 FROM {_BOUND} WHERE r.id <> c.id AND r.project = c.project AND r.tender = c.tender AND r.business = c.business AND r.technical IS NOT DISTINCT FROM c.technical) AS allowed FROM {_CHANGED}")
def relation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a relation may be changed: no other one of its project has the same documents, a missing one like another."""
    r, c = rows(spark, _BOUND).alias("r"), rows(spark, _CHANGED).alias("c")
    same = (F.col("r.id") != F.col("c.id")) & (F.col("r.project") == F.col("c.project")) & (F.col("r.tender") == F.col("c.tender")) & (F.col("r.business") == F.col("c.business")) & F.col("r.technical").eqNullSafe(F.col("c.technical"))
    hit = c.join(r, same, "left_semi").select("id", "business").distinct().withColumn("taken", F.lit(True))
    return c.join(hit, ["id", "business"], "left").select("id", "business", F.col("taken").isNull().alias("allowed"))


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND (c_name ILIKE '%00001%' OR CAST(o_orderkey AS VARCHAR) ILIKE '%00001%') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 5")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of results joined to live projects, by keyword, the newest first."""
    word = "%00001%"
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.where(F.col("c_name").ilike(word) | F.col("o_orderkey").cast("string").ilike(word))
    return j.select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(5).limit(20)


_TREE = "(VALUES (1, '{\"price\": [{\"id\": \"a\", \"value\": \"5\"}, {\"id\": \"b\", \"value\": null}], \"seal\": []}'), (2, '{}'), (3, NULL)) AS t(review, tree)"


@query("SELECT * FROM (VALUES (1, 'price', 'a', '5', true), (1, 'price', 'b', NULL, false)) AS t(review, section, item, value, filled)")
def editable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review's tree as rows that can be edited one by one."""
    tree = F.from_json("tree", "map<string, array<struct<id: string, value: string>>>")
    s = rows(spark, _TREE).select("review", F.explode(tree).alias("section", "items")).select("review", "section", F.explode("items").alias("x"))
    return s.select("review", "section", F.col("x.id").alias("item"), "x.value", F.col("x.value").isNotNull().alias("filled"))


_TENDERS = "(VALUES (1, 'a', '预算金额100万元'), (1, 'b', '最高限价120万元'), (2, 'a', '最高限价120万元'), (2, 'b', '最高限价1,200,000.00元'), (2, 'c', '保证金2万元'), (3, 'a', '预付30%，验收后支付70%'), (3, 'b', '预付40%，验收后支付60%'), (4, 'a', '商务20分，技术50分，价格30分，总分100分')) AS t(doc_id, category, text)"


@query("SELECT * FROM (VALUES (1, 'budget_vs_limit', 'fail'), (1, 'limit_consistency', 'pass'), (2, 'budget_vs_limit', 'pass'), (2, 'limit_consistency', 'pass'), (2, 'security_ratio', 'pass'), (3, 'payment_consistency', 'fail'), (4, 'evaluation_points', 'pass')) AS t(doc_id, \"check\", status)")
def tender_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six checks of tenders, those that could be decided."""
    return tender_checks(rows(spark, _TENDERS)).where("status <> 'unclear'")
