"""Steps over prices, rates, scores, tables and findings of bid documents; see bids.py for their fixtures' form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.bids import rows
from quillspark.plans.registry import query, table

#: Phrases of limits and the comparison that each asks for, the first that a text begins with counts.
PHRASES = {"不低于": ">=", "不少于": ">=", "不高于": "<=", "不超过": "<=", "低于": "<", "高于": ">", "大于": ">", "小于": "<"}
#: Capital amounts.
CAPITAL = "[零壹贰叁肆伍陆柒捌玖拾佰仟万亿]+(?:元|圆)[整正零壹贰叁肆伍陆柒捌玖角分]*"
SMALL = "小写[：:] *[￥¥]? *([0-9,，]+(?:[.][0-9]+)?)"
#: Difference of a product and a total that counts as none; pages within which a total belongs to a table.
NEAR_AMOUNT, NEAR_PAGES = 0.1, 2
#: What a page scores as the opening sheet by what it holds.
SIGNALS = {"开标一览表": 18, "投标总价": 12, "下浮率": 8, "目录": -20, "合同金额": -10, "偏离表": -8, "不低于": 2, "否决": 2}
#: Ranks of evidence: what is weaker may be covered by what is stronger.
RANKS = {"table": 3, "section": 2, "block": 1}


def events_of(lines: DataFrame) -> DataFrame:
    """(doc, i, line) to the lines that state an amount in figures or in capitals: doc, i, small, capital."""
    small = F.nullif(F.regexp_extract("line", SMALL, 1), F.lit(""))
    capital = F.nullif(F.regexp_extract("line", CAPITAL, 0), F.lit(""))
    return lines.select("doc", "i", small.alias("small"), capital.alias("capital")).where("small is not null or capital is not null")


_OPENING = "(VALUES (1, 1, '小写：￥1,200,000.00元 大写：壹佰贰拾万元整'), (1, 2, '小写: 300元'), (1, 3, '说明'), (1, 4, '叁佰元整'), (1, 5, '伍佰元整'), (2, 1, '大写：伍元整'), (2, 2, NULL), (2, 3, '小写：7'), (2, 4, '小写：8'), (2, 5, '捌元整')) AS t(doc, i, line)"


@query(f"WITH e AS (SELECT doc, i, nullif(regexp_extract(line, '{SMALL}', 1), '') AS small, nullif(regexp_extract(line, '{CAPITAL}'), '') AS capital FROM {_OPENING}), f AS (SELECT *, lag(small) OVER w AS s, lag(capital) OVER w AS c FROM e WHERE small IS NOT NULL OR capital IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY i)) SELECT doc, i, CAST(replace(replace(coalesce(small, CASE WHEN c IS NULL THEN s END), ',', ''), '，', '') AS DOUBLE) AS figures, capital FROM f WHERE capital IS NOT NULL AND coalesce(small, CASE WHEN c IS NULL THEN s END) IS NOT NULL")
def price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in capitals with the amount in figures on their line, else with the last one before that no other has taken."""
    w = Window.partitionBy("doc").orderBy("i")
    before = F.when(F.lag("capital").over(w).isNull(), F.lag("small").over(w))
    e = events_of(rows(spark, _OPENING)).withColumn("figures", F.coalesce("small", before)).where("capital is not null and figures is not null")
    return e.select("doc", "i", F.regexp_replace("figures", "[,，]", "").cast("double").alias("figures"), "capital")


_RULES = "(VALUES (1, '施工图审查费下浮率不低于5%。监理服务费下浮率须不少于10.5%'), (2, '本项目下浮率不低于8%。低于或等于所要求的下浮比例的否决投标'), (3, '折扣率不高于95%'), (4, '交货期30天'), (5, NULL)) AS t(doc, text)"
_RULE = "([一-鿿]*?)(?:服务费|费|业务|项目)?(下浮率|折扣率)(?:须|应|必须)?(不低于|不少于|不高于|不超过|低于|高于|大于|小于)([0-9]+(?:[.][0-9]+)?)%"
_OP = "CASE " + " ".join(f"WHEN phrase = '{p}' THEN '{op}'" for p, op in PHRASES.items()) + " END"


@query(f"WITH s AS (SELECT doc, text, unnest(string_split_regex(text, '[。；;，,]')) AS sentence FROM {_RULES}), m AS (SELECT doc, text, regexp_extract(sentence, '{_RULE}', 1) AS name, regexp_extract(sentence, '{_RULE}', 2) AS label, regexp_extract(sentence, '{_RULE}', 3) AS phrase, regexp_extract(sentence, '{_RULE}', 4) AS threshold FROM s WHERE regexp_matches(sentence, '{_RULE}')) SELECT doc, CASE WHEN name IN ('', '本') THEN 'generic' ELSE name END AS name, label, CASE WHEN contains(text, '低于或等于所要求') AND contains(text, '否决') AND {_OP} = '>=' THEN '>' ELSE {_OP} END AS op, CAST(threshold AS DOUBLE) AS threshold FROM m")
def rate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that limit a rate: whose, which, the comparison and the threshold; a clause that rejects equality makes the
    comparison strict."""
    s = rows(spark, _RULES).select("doc", "text", F.explode(F.split("text", "[。；;，,]")).alias("sentence")).where(F.col("sentence").rlike(_RULE))
    part = lambda i: F.regexp_extract("sentence", _RULE, i)
    op = F.lit(None).cast("string")
    for phrase, sign in PHRASES.items():
        op = F.when(part(3) == phrase, sign).otherwise(op)
    strict = F.col("text").contains("低于或等于所要求") & F.col("text").contains("否决") & (op == ">=")
    return s.select("doc", F.when(part(1).isin("", "本"), "generic").otherwise(part(1)).alias("name"), part(2).alias("label"), F.when(strict, ">").otherwise(op).alias("op"), part(4).cast("double").alias("threshold"))


_SCORED = "(VALUES (1, '业绩', '10分', '每有一项得2分'), (2, '服务', '', '优15-20分，良7-14分，差0-6分'), (3, '资料', '5分', '每缺一项扣1分，最多扣5分'), (4, '缺项', '', '每处扣0.5分，最多扣3分'), (5, '其他', '', '由评委酌情'), (6, NULL, NULL, NULL)) AS t(id, name, most, criteria)"


@query(f"SELECT id, CASE WHEN contains(c, '扣') THEN 'deduction' WHEN len(r) > 0 THEN 'interval' WHEN m IS NOT NULL OR len(f) > 0 THEN 'fixed' ELSE 'unknown' END AS type, CASE WHEN contains(c, '扣') THEN coalesce(m, TRY_CAST(nullif(regexp_extract(c, '最多扣([0-9.]+)', 1), '') AS DOUBLE)) WHEN m IS NOT NULL THEN m WHEN len(r) > 0 THEN list_max(list_transform(r, lambda x: CAST(x AS DOUBLE))) WHEN len(f) > 0 THEN list_max(list_transform(f, lambda x: CAST(x AS DOUBLE))) END AS most FROM (SELECT id, coalesce(criteria, '') AS c, TRY_CAST(nullif(regexp_extract(coalesce(most, ''), '([0-9.]+)分', 1), '') AS DOUBLE) AS m, regexp_extract_all(coalesce(criteria, ''), '[0-9.]+-([0-9.]+)分', 1) AS r, regexp_extract_all(coalesce(criteria, ''), '([0-9.]+)分', 1) AS f FROM {_SCORED})")
def scoring_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an item is scored (by deductions, by ranges, fixed) and its most points: stated, else what the criteria allow."""
    c = F.coalesce("criteria", F.lit(""))
    point = lambda text, rx: F.nullif(F.regexp_extract(text, rx, 1), F.lit("")).cast("double")
    every = lambda rx: F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(1)), lambda x: x.cast("double"))
    most, ranges, fixed = point(F.coalesce("most", F.lit("")), "([0-9.]+)分"), every("[0-9.]+-([0-9.]+)分"), every("([0-9.]+)分")
    minus = c.contains("扣")
    kind = F.when(minus, "deduction").when(F.size(ranges) > 0, "interval").when(most.isNotNull() | (F.size(fixed) > 0), "fixed").otherwise("unknown")
    top = F.when(minus, F.coalesce(most, point(c, "最多扣([0-9.]+)"))).when(most.isNotNull(), most).when(F.size(ranges) > 0, F.array_max(ranges)).when(F.size(fixed) > 0, F.array_max(fixed))
    return rows(spark, _SCORED).select("id", kind.alias("type"), top.alias("most"))


_TABLES = "(VALUES (1, '分项报价表', 10, 12, 1), (2, '分项报价表', 13, 13, 0), (3, '报价明细', 11, 11, 1), (4, '分项报价表', 40, 41, 1)) AS t(id, anchor, first, last, logical)"
_TOTALS = "(VALUES (1, '合计', 13), (2, '总价', 44), (3, '投标总价', 90), (4, '小计', NULL), (5, '附件合计', 60)) AS t(id, label, page)"


@query(f"WITH s AS (SELECT *, (CASE WHEN anchor = '分项报价表' THEN 1 ELSE 0 END, logical, -abs(first - 9), -first) AS o FROM {_TABLES}), b AS (SELECT arg_max(id, o) AS id, arg_max(anchor, o) AS anchor, arg_max(first, o) AS first FROM s) SELECT s.id FROM s, b WHERE s.id = b.id OR (s.anchor = b.anchor AND abs(s.first - b.first) <= 2)")
def primary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several price tables the one nearest to the opening total's page (9 here), and those of its kind that follow it."""
    t = rows(spark, _TABLES)
    order = F.struct(F.when(F.col("anchor") == "分项报价表", 1).otherwise(0).alias("named"), "logical", (-F.abs(F.col("first") - 9)).alias("near"), (-F.col("first")).alias("early"))
    best = t.agg(F.max_by(F.struct("id", "anchor", "first"), order).alias("b"))  # a single row
    near = (F.col("anchor") == F.col("b.anchor")) & (F.abs(F.col("first") - F.col("b.first")) <= NEAR_PAGES)
    return t.join(F.broadcast(best), F.lit(True)).where((F.col("id") == F.col("b.id")) | near).select("id")


@query(f"SELECT t.id, label = '投标总价' OR (page IS NOT NULL AND EXISTS (SELECT 1 FROM {_TABLES.replace('AS t(', 'AS x(')} WHERE id IN (1, 2) AND t.page BETWEEN x.first - 2 AND x.last + 2)) AS kept FROM {_TOTALS}")
def primary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals near the primary tables' pages, and those that the opening sheet names, are kept; others are set aside."""
    near = rows(spark, _TABLES).where("id in (1, 2)").select(F.explode(F.sequence(F.col("first") - NEAR_PAGES, F.col("last") + NEAR_PAGES)).alias("page")).distinct().withColumn("near", F.lit(True))
    t = rows(spark, _TOTALS).join(near, "page", "left")
    return t.select("id", ((F.col("label") == "投标总价") | F.coalesce("near", F.lit(False))).alias("kept"))


_ROWS = "(VALUES (1, '1|电脑|台|10|5000|50000'), (2, '2|打印机||台|3|2000|6000'), (3, '电脑|台|2|100|200'), (4, '4|x|y|1|2|9'), (5, NULL), (6, '')) AS t(id, cells)"


@query(f"WITH c AS (SELECT id, list_transform(string_split(cells, '|'), lambda x: TRY_CAST(nullif(x, '') AS DOUBLE)) AS v FROM {_ROWS}), o AS (SELECT id, v, unnest([0, 1, -1]) AS shift FROM c) SELECT id, arg_min(shift, list_position([0, 1, -1], shift)) AS shift, CAST(arg_min(v[6 + shift], list_position([0, 1, -1], shift)) AS DOUBLE) AS total FROM o WHERE abs(v[4 + shift] * v[5 + shift] - v[6 + shift]) <= 0.1 GROUP BY id")
def shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose quantity times price gives the total, if need be with all cells one place further or before."""
    v = F.transform(F.split("cells", "[|]"), lambda x: F.when(x.rlike("^[0-9]+([.][0-9]+)?$"), x).cast("double"))
    o = rows(spark, _ROWS).select("id", v.alias("v"), F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("place", "shift"))
    cell = lambda i: F.get("v", F.col("shift") + i)
    o = o.withColumn("total", cell(5)).where(F.abs(cell(3) * cell(4) - F.col("total")) <= NEAR_AMOUNT)
    return o.groupBy("id").agg(F.min_by("shift", "place").alias("shift"), F.min_by("total", "place").alias("total"))


_PAYLOADS = "(VALUES (1, '<table><tr><td>a</td></tr><tr><td>b</td></tr></table>', '| a |', 'x'), (2, NULL, 'h¶---¶r1¶r2', 'x'), (3, '', '', 'a\tb¶c\td'), (4, NULL, NULL, 'plain¶text'), (5, NULL, NULL, NULL)) AS t(id, html, markdown, text)".replace("\t", " / ")


@query(f"SELECT id, CASE WHEN contains(html, '<table') THEN 'html' WHEN contains(markdown, '---') THEN 'markdown' WHEN contains(text, ' / ') THEN 'cells' WHEN text <> '' THEN 'plain' ELSE 'none' END AS parser, CAST(CASE WHEN contains(html, '<table') THEN len(regexp_extract_all(html, '<tr')) WHEN contains(markdown, '---') THEN len(string_split(markdown, '¶')) - 1 WHEN text <> '' THEN len(string_split(text, '¶')) ELSE 0 END AS INTEGER) AS rows FROM {_PAYLOADS}")
def parser_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of a table that counts, by the best form that it came in, and its rows."""
    html, mark, cells, plain = F.col("html").contains("<table"), F.col("markdown").contains("---"), F.col("text").contains(" / "), F.col("text") != ""
    lines = lambda c: F.size(F.split(c, "¶"))
    parser = F.when(html, "html").when(mark, "markdown").when(cells, "cells").when(plain, "plain").otherwise("none")
    n = F.when(html, F.regexp_count("html", F.lit("<tr"))).when(mark, lines("markdown") - 1).when(plain, lines("text")).otherwise(0)
    return rows(spark, _PAYLOADS).select("id", parser.alias("parser"), n.alias("rows"))


_HEADED = "(VALUES (1, '序号|招标要求|投标响应|偏离说明|所在页'), (2, '编号|条款内容|响应情况|备注'), (3, '名称|价格'), (4, NULL)) AS t(id, heads)"
_ROLES = {"serial": "序号|编号", "requirement": "要求|条款", "response": "响应", "deviation": "偏离", "page": "页"}
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(h, '{rx}') THEN '{role}'" for role, rx in _ROLES.items()) + " END"


@query(f"WITH h AS (SELECT id, unnest(string_split(heads, '|')) AS h, generate_subscripts(string_split(heads, '|'), 1) - 1 AS col FROM {_HEADED}) SELECT id, {_ROLE} AS role, CAST(min(col) AS INTEGER) AS col FROM h WHERE {_ROLE} IS NOT NULL GROUP BY 1, 2")
def deviation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a deviation table by what their heads say; of several heads of a role the first counts."""
    role = F.lit(None).cast("string")
    for name, rx in reversed(_ROLES.items()):
        role = F.when(F.col("h").rlike(rx), name).otherwise(role)
    h = rows(spark, _HEADED).select("id", F.posexplode(F.split("heads", "[|]")).alias("col", "h")).withColumn("role", role)
    return h.where("role is not null").groupBy("id", "role").agg(F.min("col").alias("col"))


_TITLED = "(VALUES (1, 5, 'own'), (2, 9, NULL), (3, 30, 'logical_table'), (4, 31, '报价表'), (5, NULL, NULL)) AS t(id, page, title)"
_HINTS = "(VALUES (5, '商务偏离表'), (7, '技术偏离表'), (11, '附录')) AS h(page, title)"


@query(f"SELECT t.id, coalesce((SELECT arg_min(h.title, (abs(h.page - t.page), CASE WHEN h.page <= t.page THEN 0 ELSE 1 END)) FROM {_HINTS} WHERE abs(h.page - t.page) <= 4), CASE WHEN t.title <> 'logical_table' THEN t.title END, '第' || t.page || '页表格', 'logical_table') AS title FROM {_TITLED}")
def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of a table: the nearest heading within four pages, one before it first, else its own, else its page."""
    hints = rows(spark, _HINTS).select(F.col("page").alias("at"), F.col("title").alias("head"), F.explode(F.sequence(F.col("page") - 4, F.col("page") + 4)).alias("page"))
    j = rows(spark, _TITLED).join(hints, "page", "left")
    order = F.when(F.col("at").isNotNull(), F.struct(F.abs(F.col("at") - F.col("page")), F.when(F.col("at") <= F.col("page"), 0).otherwise(1)))
    best = j.groupBy("id", "page", "title").agg(F.min_by("head", order).alias("head"))
    own = F.when(F.col("title") != "logical_table", F.col("title"))
    return best.select("id", F.coalesce("head", own, F.concat(F.lit("第"), F.col("page"), F.lit("页表格")), F.lit("logical_table")).alias("title"))


_MARKS = "(VALUES (1, 'seal', 2, '甲公司章'), (1, 'seal', 2, '甲公司章'), (1, 'signature', 3, NULL), (1, 'seal', 1, '法人章'), (2, 'signature', 1, '张三')) AS t(doc, kind, page, text)"


@query(f"SELECT doc, kind, count(*) AS n, string_agg(DISTINCT text, ',' ORDER BY text) AS texts, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM {_MARKS} GROUP BY 1, 2")
def mark_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals and signatures of a document: how many, what they say, and on which pages."""
    each = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    return rows(spark, _MARKS).groupBy("doc", "kind").agg(F.count("*").alias("n"), each("text").alias("texts"), each(F.col("page").cast("string")).alias("pages"))


_SHEETS = "(VALUES (1, '目录 开标一览表 3'), (2, '投标函 不低于90天'), (3, '开标一览表 投标总价 100元'), (4, '合同金额 投标总价'), (5, NULL)) AS t(page, text)"
_SCORE = " + ".join(f"CASE WHEN contains(text, '{w}') THEN {n} ELSE 0 END" for w, n in SIGNALS.items())


@query(f"SELECT arg_max(page, ({_SCORE}, -page)) AS page, CAST(max({_SCORE}) AS INTEGER) AS score FROM {_SHEETS} WHERE text IS NOT NULL")
def opening_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that looks most like the opening sheet."""
    score = sum((F.when(F.col("text").contains(w), n).otherwise(0) for w, n in SIGNALS.items()), F.lit(0))
    s = rows(spark, _SHEETS).where("text is not null").withColumn("score", score)
    return s.agg(F.max_by("page", F.struct("score", -F.col("page"))).alias("page"), F.max("score").alias("score"))


_EVIDENCE = "(VALUES (1, 1, 'section', 1, 4, '甲乙丙丁戊己'), (2, 1, 'block', 2, 2, '乙丙丁'), (3, 1, 'block', 9, 9, '乙丙丁'), (4, 1, 'table', 3, 3, '丙丁戊'), (5, 2, 'block', 2, 2, '乙丙丁'), (6, 1, 'block', 3, 3, '丙丁'), (7, 1, 'block', 3, 3, NULL)) AS t(id, pair, kind, first, last, text)"
_RANK = "CASE {0}.kind " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in RANKS.items()) + " END"


@query(f"SELECT id FROM {_EVIDENCE} WHERE NOT EXISTS (SELECT 1 FROM {_EVIDENCE.replace('AS t(', 'AS x(')} WHERE x.pair = t.pair AND {_RANK.format('x')} > {_RANK.format('t')} AND x.first <= t.last AND t.first <= x.last AND contains(x.text, t.text))")
def evidence_subsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that no stronger kind on its pages holds: blocks go if a section or table does, tables if a section would."""
    rank = F.lit(0)
    for k, r in RANKS.items():
        rank = F.when(F.col("kind") == k, r).otherwise(rank)
    e = rows(spark, _EVIDENCE).withColumn("rank", rank)
    x = e.select("pair", F.col("rank").alias("r"), F.col("text").alias("held_in"), F.explode(F.sequence("first", "last")).alias("page")).alias("x")
    y = e.where("text is not null").select("id", "pair", "rank", "text", F.explode(F.sequence("first", "last")).alias("page")).alias("y")
    gone = y.join(x, (F.col("x.pair") == F.col("y.pair")) & (F.col("x.page") == F.col("y.page")) & (F.col("r") > F.col("rank")) & F.col("held_in").contains(F.col("text"))).select("id").distinct()
    return e.join(gone, "id", "left_anti").select("id")


_CLUSTERS = "(VALUES (1, 6, 'a', 1, 9, '总价'), (1, 6, 'b', 3, 8, '总价'), (2, 4, 'a', 2, 3, '总价表'), (2, 4, 'b', 4, 4, '总价表'), (3, 4, 'a', 2, 3, '工期'), (3, 4, 'b', 4, 4, '工期'), (4, 4, 'a', 2, 3, '总价'), (4, 4, 'b', 9, 10, '总价'), (5, 6, 'a', 2, 3, '总价'), (5, 6, 'b', 4, 4, '总价')) AS t(id, rank, file, first, last, token)"


@query(f"WITH c AS (SELECT * FROM {_CLUSTERS}), m AS (SELECT s.id AS strong, w.id AS weak, s.rank AS rank, count(*) AS files, bool_and(s.first - CASE WHEN s.rank = 6 AND w.rank = 4 THEN 1 ELSE 0 END <= w.first AND w.last <= s.last + CASE WHEN s.rank = 6 AND w.rank = 4 THEN 1 ELSE 0 END) AS covered, bool_or(contains(s.token, w.token) OR contains(w.token, s.token)) AS related FROM c s JOIN c w ON s.file = w.file AND s.rank > w.rank GROUP BY 1, 2, 3) SELECT weak, arg_max(strong, (rank, -strong)) AS strong FROM m WHERE files >= 2 AND covered AND related GROUP BY weak")
def cluster_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that a stronger one takes in: their tokens are related, they share two files or more, and its ranges cover
    theirs in each (a page more on either side, if it is of sections and they of blocks). Clusters meet in their files."""
    c = rows(spark, _CLUSTERS)
    s, w = c.alias("s"), c.alias("w")
    more = F.when((F.col("s.rank") == 6) & (F.col("w.rank") == 4), 1).otherwise(0)
    met = s.join(w, (F.col("s.file") == F.col("w.file")) & (F.col("s.rank") > F.col("w.rank")))
    covered = (F.col("s.first") - more <= F.col("w.first")) & (F.col("w.last") <= F.col("s.last") + more)
    related = F.col("s.token").contains(F.col("w.token")) | F.col("w.token").contains(F.col("s.token"))
    m = met.groupBy(F.col("s.id").alias("strong"), F.col("w.id").alias("weak"), F.col("s.rank").alias("rank")).agg(F.count("*").alias("files"), F.bool_and(covered).alias("covered"), F.bool_or(related).alias("related"))
    return m.where("files >= 2 and covered and related").groupBy("weak").agg(F.max_by("strong", F.struct("rank", -F.col("strong"))).alias("strong"))


_SOURCES = "(VALUES ('d1', '甲公司.PDF'), ('d2', '乙公司.pdf'), ('d3', '乙公司.pdf'), ('d4', NULL)) AS t(doc, name)"
_FOUND = "(VALUES (1, '甲公司.pdf', 3), (2, '乙公司.pdf', 1), (3, '丙公司.pdf', 2), (4, NULL, 1)) AS t(id, name, page)"


@query(f"WITH i AS (SELECT lower(name) AS k, min(doc) AS doc, count(*) AS n FROM {_SOURCES} WHERE name IS NOT NULL GROUP BY 1) SELECT id, page, doc, coalesce(n > 1, false) AS ambiguous FROM {_FOUND} LEFT JOIN i ON lower(name) = k")
def source_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the document that their file's name refers to; of several documents of a name the first, and it is said."""
    i = rows(spark, _SOURCES).where("name is not null").groupBy(F.lower("name").alias("k")).agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    return rows(spark, _FOUND).join(i, F.lower("name") == F.col("k"), "left").select("id", "page", "doc", F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


_OLD = "(VALUES ('甲', 'price', 'fail'), ('甲', 'seal', 'unclear'), ('乙', 'price', 'pass'), ('乙', 'seal', 'missing')) AS o(party, check_code, status)"
_NEW = "(VALUES ('甲', 'price', 'pass'), ('甲', 'seal', 'fail'), ('乙', 'price', 'pass'), ('丙', 'seal', 'pass')) AS n(party, check_code, status)"
_WORSE = "list_position(['pass', 'unclear', 'missing', 'fail'], {0}.status)"


@query(f"SELECT coalesce(o.party, n.party) AS party, coalesce(o.check_code, n.check_code) AS check_code, o.status AS old, n.status AS new, CASE WHEN o.status IS NULL THEN 'added' WHEN n.status IS NULL THEN 'removed' WHEN {_WORSE.format('n')} < {_WORSE.format('o')} THEN 'improved' WHEN {_WORSE.format('n')} > {_WORSE.format('o')} THEN 'worsened' ELSE 'same' END AS change FROM {_OLD} FULL JOIN {_NEW} ON o.party = n.party AND o.check_code = n.check_code")
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews of the same parties, check by check."""
    o, n = rows(spark, _OLD).withColumnRenamed("status", "old"), rows(spark, _NEW).withColumnRenamed("status", "new")
    bad = lambda c: F.array_position(F.array(*map(F.lit, ("pass", "unclear", "missing", "fail"))), F.col(c))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(bad("new") < bad("old"), "improved").when(bad("new") > bad("old"), "worsened").otherwise("same")
    return o.join(n, ["party", "check_code"], "full").withColumn("change", change)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(CAST(l_extendedprice AS DECIMAL(18, 4)) * CAST(0.125 AS DECIMAL(4, 3)), 2)::DOUBLE AS half_even FROM lineitem")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares rounded to cents, halves to the even cent."""
    share = F.col("l_extendedprice").cast("decimal(18, 4)") * F.lit("0.125").cast("decimal(4, 3)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(share, 2).cast("double").alias("half_even"))


_SAID = "(VALUES (1, '格式条款', '投标有效期90天 签字盖章'), (2, '其他', '见附件'), (3, NULL, NULL)) AS t(page, head, text)"


@query(f"SELECT find, page, CAST(instr(text, find) AS INTEGER) AS at FROM (VALUES ('有效期', '1,2'), ('附件', '1'), ('附件', '2,3')) AS f(find, allowed), {_SAID} WHERE contains(text, find) AND list_contains(string_split(allowed, ','), CAST(page AS VARCHAR))")
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts stand on the pages that are allowed for them; pages meet texts by page, not all by all."""
    f = rows(spark, "(VALUES ('有效期', '1,2'), ('附件', '1'), ('附件', '2,3')) AS f(find, allowed)")
    f = f.select("find", F.explode(F.split("allowed", ",")).alias("page")).withColumn("page", F.col("page").cast("int"))
    return rows(spark, _SAID).join(f, "page").where(F.col("text").contains(F.col("find"))).select("find", "page", F.expr("instr(text, find)").alias("at"))
