"""Steps over the parts of bid documents: scopes, sections, attachments, tables, evidence, prices, scores.

Each step is a function of tables in long form (a row for each section, table, row or mark). Its query runs on the fixture
beside it, as the given tables hold no such documents; the fixture is SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.matching import matched_texts, ratio, same
from quillspark.plans.registry import kept, query, table

#: Scopes of the duplicate check and the sources of segments that each lets through.
SCOPES = {"full": None, "itemized": "itemized_pricing", "deviation": "deviation_table"}
#: Column heads of deviation tables, and words that a row's answer must have.
HEADS = ("序号", "招标要求", "投标响应", "偏离", "说明", "页码")
ANSWERS = "响应|相同|满足|符合|偏离|详见"
#: Statements that nothing deviates.
NO_DEVIATION = "(?:全部|所有).{0,8}(?:响应|满足).{0,18}(?:无偏离|未偏离|没有偏离)|(?:无偏离|未偏离).{0,18}(?:全部|所有).{0,8}(?:响应|满足)|完全响应.{0,20}(?:要求|条款).{0,20}(?:无偏离|未偏离|没有偏离)"
#: Scores of a heading and of a body that holds a title, some of its parts, or one long part.
HEADING, CANDIDATE, TITLE, PARTS, PART = 120, 80, 100, 60, 40
#: Characters of signatures that are compared, and from which ratio two are one table.
COMPARED, ONE_TABLE = 400, 0.9
#: Ratio from which rows, and tables of such rows, are alike; score from which a seal names the bidder.
ROWS_ALIKE, TABLES_ALIKE, NAMED = 0.78, 0.72, 0.45


def rows(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\r\\n]+", "")


def signature(text: Column) -> Column:
    """A table's text without marks, blanks and case."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]+", ""))


_SEGMENTS = "(VALUES (1, 'itemized_pricing', '报价表', '甲 1|乙 2', NULL), (2, 'deviation_table', '偏离表', '无偏离', NULL), (3, 'itemized_pricing', '报价表', '甲1|乙2', '0,0,9,9'), (4, 'itemized_pricing', '报价 表', '甲1|乙2', '1,1,2,2'), (5, 'other', '', '', NULL), (6, NULL, NULL, NULL, NULL), (7, 'deviation_table', '偏离表', '无 偏离', NULL)) AS t(seq, source, title, lines, bbox)"


@query(f"SELECT scope, seq FROM {_SEGMENTS}, (VALUES ('full', NULL), ('itemized', 'itemized_pricing'), ('deviation', 'deviation_table')) AS s(scope, allowed) WHERE allowed IS NULL OR source = allowed")
def segment_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that each scope of the check lets through; the full one all, those without a source too."""
    s = rows(spark, _SEGMENTS)
    parts = [s.where(F.lit(True) if allowed is None else F.col("source") == allowed).select(F.lit(scope).alias("scope"), "seq") for scope, allowed in SCOPES.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH k AS (SELECT *, regexp_replace(coalesce(source, '') || coalesce(title, '') || coalesce(lines, ''), '[ \\t\\r\\n]+', '', 'g') AS k FROM {_SEGMENTS}) SELECT k, arg_min(seq, (bbox IS NULL, seq)) AS seq FROM k WHERE k <> '' GROUP BY k")
def segment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of segments with one source, title and text (blanks apart) the first with a place, else the first; empty ones go."""
    k = compact(F.concat(*[F.coalesce(x, F.lit("")) for x in ("source", "title", "lines")]))
    return rows(spark, _SEGMENTS).withColumn("k", k).where("k <> ''").groupBy("k").agg(F.min_by("seq", F.struct(F.col("bbox").isNull(), "seq")).alias("seq"))


@query("SELECT doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z一-鿿]+', '', 'g'))) AS signature FROM documents")
def table_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(signature(F.coalesce("text", F.lit(""))), 256).alias("signature"))


def first_kept(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq), (keys, a, b) with a < b in seq to the nodes that a walk in order keeps, which drops what is linked to one that
    it has kept. In each round nodes without an earlier open neighbour are kept and their later ones dropped; a chain of n
    falls in n rounds at most, what is usual in two or three. Rounds are written to the shared folder."""
    left, edges, out = kept(nodes.select(*keys, "seq")), kept(links.select(*keys, "a", "b").distinct()), None
    while not left.isEmpty():
        later = edges.select(*keys, F.col("b").alias("seq")).distinct().alias("e")
        now = kept(left.alias("n").join(later, same("n", "e", *keys, "seq"), "left_anti"))
        out = now if out is None else out.union(now)
        gone = kept(edges.alias("e").join(now.alias("n"), same("e", "n", *keys) & (F.col("e.a") == F.col("n.seq")), "left_semi").select(*keys, F.col("b").alias("seq")).union(now).distinct())
        left = kept(left.alias("n").join(gone.alias("g"), same("n", "g", *keys, "seq"), "left_anti"))
        for end in "ab":
            edges = edges.alias("e").join(gone.alias("g"), same("e", "g", *keys) & (F.col(f"e.{end}") == F.col("g.seq")), "left_anti")
        edges = kept(edges)
    return nodes.select(*keys, "seq") if out is None else out


def distinct_tables(tables: DataFrame, group: str) -> DataFrame:
    """(group, seq, page, text) to the tables (group, seq) that stay: one goes if a table before it that stays is on its page
    and is equal, holds it or is held by it (from 8 characters on), or alike in its first COMPARED characters. Tables meet
    on their page only. Empty ones, nulls too, are no tables' copies and stay."""
    t = kept(tables.select(group, "seq", "page", signature(F.coalesce("text", F.lit(""))).alias("s")))
    a, b = t.where("s <> ''").alias("a"), t.where("s <> ''").alias("b")
    held = (F.least(F.char_length("a.s"), F.char_length("b.s")) >= 8) & (F.col("a.s").contains(F.col("b.s")) | F.col("b.s").contains(F.col("a.s")))
    met = a.join(b, same("a", "b", group, "page") & (F.col("a.seq") < F.col("b.seq"))).withColumn("held", (F.col("a.s") == F.col("b.s")) | held)
    sure = met.where("held").select(f"a.{group}", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))
    long = met.where(~F.col("held") & (F.least(F.char_length("a.s"), F.char_length("b.s")) >= 8)).select(f"a.{group}", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), F.left("a.s", F.lit(COMPARED)).alias("x"), F.left("b.s", F.lit(COMPARED)).alias("y"))
    return first_kept(t, sure.union(long.where(ratio("x", "y") >= ONE_TABLE).select(group, "a", "b")), [group])


@query()
def table_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the tables of a page, as two parsers would both find them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.lit(1).alias("page"), "text")
    return distinct_tables(c, "conv_id")


def similar_tables(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, t, i, text), a row for each row of a table, twice to group, l, r, score: tables alike. Rows are matched one to
    one from ROWS_ALIKE on for each pair of tables; the score is the matched share of the smaller table's rows."""
    sizes = [x.where("text <> ''").groupBy(group, "t").agg(F.count("*").alias("n")) for x in (left, right)]
    pairs = kept(sizes[0].alias("l").join(sizes[1].alias("r"), same("l", "r", group)).select(f"l.{group}", F.col("l.t").alias("l"), F.col("r.t").alias("r"), F.least("l.n", "r.n").alias("n")))
    key = F.struct(group, "l", "r").alias("pair")
    side = lambda d, t: d.alias("d").join(pairs.alias("p"), same("d", "p", group) & (F.col("d.t") == F.col(f"p.{t}"))).select(F.struct(f"p.{group}", "p.l", "p.r").alias("pair"), "i", "text")
    texts = [side(left, "l"), side(right, "r")]
    # equal rows are matched first, the k-th of the one side with the k-th of the other
    nth = lambda side, k: Window.partitionBy("pair", "text").orderBy(k)
    x, y = (t.where("text <> ''").withColumn("k", F.row_number().over(nth(t, "i"))) for t in texts)
    equal = x.alias("x").join(y.alias("y"), same("x", "y", "pair", "text", "k")).select("x.pair", F.col("x.i").alias("a"), F.col("y.i").alias("b"))
    used = [equal.select("pair", F.col(c).alias("i")).alias("u") for c in "ab"]
    rest = [t.alias("t").join(u, same("t", "u", "pair", "i"), "left_anti") for t, u in zip(texts, used)]
    near = matched_texts(*rest, "pair", ROWS_ALIKE).select("pair", "a", "b")
    found = equal.union(near).groupBy("pair").agg(F.count("*").alias("m")).alias("m")
    p = pairs.select(key, "n").alias("p")
    return p.join(found, same("p", "m", "pair")).select("p.pair.*", (F.col("m") / F.col("n")).alias("score")).where(F.col("score") >= TABLES_ALIKE)


@query()
def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' and assistants' turns of a conversation as tables of lines."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("t"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return similar_tables(c.where("role = 'user'").drop("role"), c.where("role = 'assistant'").drop("role"), "conv_id")


_FILES = "(VALUES ('招标文件.json', '{\"pages\": [1, 2, 3]}'), ('甲公司商务标.json', '{\"pages\": [1]}'), ('甲公司技术标.json', '{\"pages\": [1, 2]}'), ('乙公司商务标.json', '{}'), ('说明.json', '{}')) AS t(name, body)"


@query(f"WITH f AS (SELECT regexp_replace(name, '[.](json|JSON)$', '') AS stem FROM {_FILES}), r AS (SELECT regexp_replace(stem, '(商务标|技术标)', '') AS party, CASE WHEN contains(stem, '商务标') THEN 'business' ELSE 'technical' END AS role FROM f WHERE NOT contains(stem, '招标') AND (contains(stem, '商务标') OR contains(stem, '技术标'))) SELECT party, bool_or(role = 'business') AND bool_or(role = 'technical') AS complete, (SELECT count(*) = 1 FROM f WHERE contains(stem, '招标')) AS one_tender FROM r GROUP BY party")
def dataset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder by party: a party is complete with a business and a technical file, a folder with one tender."""
    f = rows(spark, _FILES).select(F.regexp_replace("name", "[.](json|JSON)$", "").alias("stem"))
    tender = F.col("stem").contains("招标")
    role = F.when(F.col("stem").contains("商务标"), "business").when(F.col("stem").contains("技术标"), "technical")
    one = f.agg((F.count_if(tender) == 1).alias("one_tender"))
    r = f.where(~tender).select(F.regexp_replace("stem", "(商务标|技术标)", "").alias("party"), role.alias("role")).where("role is not null")
    return r.groupBy("party").agg((F.bool_or(F.col("role") == "business") & F.bool_or(F.col("role") == "technical")).alias("complete")).crossJoin(F.broadcast(one))  # one is a single row


@query(f"SELECT name, sha256(body) AS digest, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, CAST(coalesce(json_array_length(body, '$.pages'), 0) AS INTEGER) AS pages FROM {_FILES}")
def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.json_array_length(F.get_json_object("body", "$.pages"))
    return rows(spark, _FILES).select("name", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("bytes"), F.coalesce(pages, F.lit(0)).alias("pages"))


_CLAUSES = "(VALUES (1, '★（3） 交货期 不超过30天；', '★'), (2, '第二条 质保三年，', NULL), (3, '2、付款方式：验收后付款', NULL), (4, '2、付款方式：验收后付款', NULL), (5, NULL, NULL), (6, '△ ★', NULL)) AS t(seq, text, mark)"
_PREFIX = "^ *(?:第[一二三四五六七八九十百]+[条章节项点]|[一二三四五六七八九十][、.．]|[0-9]+[、.．)]|[（(][0-9]{1,2}[)）]) *"


@query(f"WITH c AS (SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[★△]', '', 'g'), '{_PREFIX}', ''), ' +', ' ', 'g'), '，,；; ') AS clean FROM {_CLAUSES}) SELECT clean, min(seq) AS seq FROM c WHERE clean <> '' GROUP BY clean")
def clean_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements without marks, numbering and closing signs, each once, where it first stands."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[★△]", ""), _PREFIX, ""), " +", " ")
    clean = F.regexp_replace(t, "^[，,；; ]+|[，,；; ]+$", "")
    return rows(spark, _CLAUSES).select("seq", clean.alias("clean")).where("clean <> ''").groupBy("clean").agg(F.min("seq").alias("seq"))


_ANSWERED = "(VALUES (1, '交货期不超过30天的全部货物', '交货期不超过30天的全部货物', ''), (2, '质保三年', '我方响应', ''), (3, '质保三年', '', '无偏离'), (4, '序号招标要求', '投标响应偏离', '说明'), (5, '', '', ''), (6, '付款', '好的', ''), (7, '付款', '付款，同意', '无偏离'), (8, NULL, NULL, '正偏离')) AS t(seq, requirement, response, deviation)"
_HITS = " + ".join(f"CAST(contains(r || s || d, '{x}') AS INTEGER)" for x in HEADS)


@query(f"WITH t AS (SELECT seq, regexp_replace(coalesce(requirement, ''), ' +', '', 'g') AS r, regexp_replace(coalesce(response, ''), ' +', '', 'g') AS s, regexp_replace(coalesce(deviation, ''), ' +', '', 'g') AS d FROM {_ANSWERED}) SELECT seq, r || s || d <> '' AND {_HITS} < 4 AND NOT (r = s AND length(r) >= 12) AND (d <> '' OR regexp_matches(s, '{ANSWERS}')) AS tells, (r <> '' AND s = '' AND d IN ('无偏离', '无')) OR (r <> '' AND contains(s, r) AND length(s) - length(r) <= 8 AND d IN ('无偏离', '无')) AS echo FROM t")
def deviation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row of a deviation table tells enough to be compared, and whether it only echoes the requirement."""
    r, s, d = (F.regexp_replace(F.coalesce(x, F.lit("")), " +", "") for x in ("requirement", "response", "deviation"))
    t = rows(spark, _ANSWERED).select("seq", r.alias("r"), s.alias("s"), d.alias("d"))
    whole = F.concat("r", "s", "d")
    hits = sum((whole.contains(x).cast("int") for x in HEADS), F.lit(0))
    copied = (F.col("r") == F.col("s")) & (F.char_length("r") >= 12)
    generic = F.col("d").isin("无偏离", "无")
    tells = (whole != "") & (hits < 4) & ~copied & ((F.col("d") != "") | F.col("s").rlike(ANSWERS))
    echo = (F.col("r") != "") & generic & ((F.col("s") == "") | (F.col("s").contains(F.col("r")) & (F.char_length("s") - F.char_length("r") <= 8)))
    return t.select("seq", tells.alias("tells"), echo.alias("echo"))


_STATED = "(VALUES (1, '我方全部响应招标文件要求，无偏离。'), (2, '未偏离，所有条款均满足'), (3, '完全响应技术要求及商务条款，没有偏离'), (4, '部分偏离'), (5, NULL)) AS t(seq, text)"


@query(f"SELECT seq, coalesce(regexp_matches(text, '{NO_DEVIATION}'), false) AS stated, coalesce(regexp_extract(text, '{NO_DEVIATION}'), '') AS said FROM {_STATED}")
def no_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a bid deviates nowhere, and their words."""
    said = F.coalesce(F.regexp_extract("text", NO_DEVIATION, 0), F.lit(""))
    return rows(spark, _STATED).select("seq", (said != "").alias("stated"), said.alias("said"))


_FLAT = "(VALUES (1, '1、质保三年 响应 2、交货 无偏离 3、付款 响应'), (2, '响应全部条款'), (3, '没有编号'), (4, NULL), (5, '1. 甲 2. 乙 2. 乙')) AS t(seq, text)"
_ROW = "[0-9]{1,3}[、.．)]"


@query(f"WITH s AS (SELECT seq, trim(unnest(string_split(regexp_replace(text, '({_ROW})', '¶\\1', 'g'), '¶'))) AS part FROM {_FLAT} WHERE len(regexp_extract_all(text, '{_ROW}')) >= 2 UNION ALL SELECT seq, text FROM {_FLAT} WHERE len(regexp_extract_all(text, '{_ROW}')) < 2 AND regexp_matches(text, '★|偏离|响应')) SELECT DISTINCT seq, part FROM s WHERE part <> ''")
def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table that came as one text, cut before their numbers, each once; text without numbers is one row if it
    answers anything."""
    t = rows(spark, _FLAT)
    n = F.regexp_count("text", F.lit(_ROW))
    many = t.where(n >= 2).select("seq", F.explode(F.split(F.regexp_replace("text", f"({_ROW})", "¶$1"), "¶")).alias("part")).select("seq", F.trim("part").alias("part"))
    one = t.where((n < 2) & F.col("text").rlike("★|偏离|响应")).select("seq", F.col("text").alias("part"))
    return many.union(one).where("part <> ''").distinct()


_NEEDS = "(VALUES ('资格承诺函', '资格承诺函|承诺函', '资格|承诺'), ('营业执照', '营业执照副本', '营业执照|统一社会信用代码'), ('业绩证明', '类似业绩', '业绩|合同')) AS n(need, titles, parts)"
_SECTIONS = "(VALUES (1, 1, 'heading', '目录'), (1, 2, 'text', '资格承诺函 3'), (3, 3, 'heading', '附件一 资格承诺函'), (4, 4, 'text', '本公司承诺 具备资格条件'), (5, 5, 'text', '统一社会信用代码 9133'), (6, 6, 'heading', '承诺函'), (7, 7, 'seal', '营业执照副本'), (8, 8, 'text', NULL)) AS s(page, seq, type, text)"
_TOC = f"SELECT DISTINCT page FROM {_SECTIONS} WHERE starts_with(regexp_replace(text, ' +', '', 'g'), '目录') AND length(regexp_replace(text, ' +', '', 'g')) <= 8"


def toc_pages(sections: DataFrame) -> DataFrame:
    """(page, text) to the pages that are a table of contents."""
    t = F.regexp_replace("text", " +", "")
    return sections.where(t.startswith("目录") & (F.char_length(t) <= 8)).select("page").distinct()


@query(f"SELECT page FROM ({_TOC})")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_pages(rows(spark, _SECTIONS))


@query(f"WITH p AS (SELECT need, page, seq, regexp_replace(text, ' +', '', 'g') AS t, titles, parts FROM {_NEEDS}, {_SECTIONS} WHERE type = 'heading' AND text IS NOT NULL AND page NOT IN ({_TOC})), c AS (SELECT need, page, seq, CASE WHEN contains(t, need) THEN {HEADING} + least(length(need), 30) ELSE 0 END AS k, list_max(list_transform(string_split(titles, '|'), lambda x: CASE WHEN NOT contains(t, x) THEN 0 WHEN x IN ('承诺函', '声明函', '证书') THEN 30 + length(x) ELSE {CANDIDATE} + least(length(x), 30) END)) AS m FROM p) SELECT need, CAST(max(greatest(k, m)) AS INTEGER) AS score, arg_max(seq, (greatest(k, m), -seq)) AS seq FROM c WHERE greatest(k, m) > 0 GROUP BY need")
def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that answers a requirement best: it holds the title, or a title that stands for it; general titles come
    last. Requirements are few and broadcast; tables of contents do not count."""
    s = rows(spark, _SECTIONS)
    s = s.where("type = 'heading' and text is not null").join(F.broadcast(toc_pages(s)), "page", "left_anti").select("page", "seq", F.regexp_replace("text", " +", "").alias("t"))
    p = s.join(F.broadcast(rows(spark, _NEEDS)), F.lit(True))
    own = F.when(F.col("t").contains(F.col("need")), HEADING + F.least(F.char_length("need"), F.lit(30))).otherwise(0)
    one = lambda x: F.when(~F.col("t").contains(x), 0).when(x.isin("承诺函", "声明函", "证书"), 30 + F.char_length(x)).otherwise(CANDIDATE + F.least(F.char_length(x), F.lit(30)))
    p = p.withColumn("score", F.greatest(own, F.array_max(F.transform(F.split("titles", "[|]"), one)))).where("score > 0")
    return p.groupBy("need").agg(F.max("score").alias("score"), F.max_by("seq", F.struct("score", -F.col("seq"))).alias("seq"))


@query(f"WITH p AS (SELECT need, page, seq, regexp_replace(text, ' +', '', 'g') AS t, string_split(titles, '|') AS ti, string_split(parts, '|') AS pa FROM {_NEEDS}, {_SECTIONS} WHERE type IN ('heading', 'text', 'table') AND text IS NOT NULL AND page NOT IN ({_TOC})), h AS (SELECT *, list_filter(ti, lambda x: length(x) >= 4 AND contains(t, x)) AS whole, list_filter(pa, lambda x: contains(t, x)) AS hit FROM p), c AS (SELECT need, seq, CASE WHEN len(whole) > 0 THEN {TITLE} + least(list_max(list_transform(whole, lambda x: length(x))), 20) WHEN len(hit) >= 2 THEN {PARTS} + 10 * len(hit) + least(list_max(list_transform(hit, lambda x: length(x))), 20) WHEN len(hit) = 1 AND length(hit[1]) >= 6 THEN {PART} + least(length(hit[1]), 20) ELSE 0 END AS score FROM h) SELECT need, CAST(max(score) AS INTEGER) AS score, arg_max(seq, (score, -seq)) AS seq FROM c WHERE score > 0 GROUP BY need")
def body_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section whose text answers a requirement best: it holds a title, or two of its parts, or one long part."""
    s = rows(spark, _SECTIONS)
    s = s.where("type in ('heading', 'text', 'table') and text is not null").join(F.broadcast(toc_pages(s)), "page", "left_anti").select("seq", F.regexp_replace("text", " +", "").alias("t"))
    p = s.join(F.broadcast(rows(spark, _NEEDS)), F.lit(True))
    whole = F.filter(F.split("titles", "[|]"), lambda x: (F.char_length(x) >= 4) & F.col("t").contains(x))
    hit = F.filter(F.split("parts", "[|]"), lambda x: F.col("t").contains(x))
    longest = lambda xs: F.least(F.array_max(F.transform(xs, lambda x: F.char_length(x))), F.lit(20))
    p = p.withColumns({"whole": whole, "hit": hit})
    score = F.when(F.size("whole") > 0, TITLE + longest("whole")).when(F.size("hit") >= 2, PARTS + 10 * F.size("hit") + longest("hit")).when((F.size("hit") == 1) & (F.char_length(F.get("hit", F.lit(0))) >= 6), PART + longest("hit")).otherwise(0)
    p = p.withColumn("score", score).where("score > 0")
    return p.groupBy("need").agg(F.max("score").alias("score"), F.max_by("seq", F.struct("score", -F.col("seq"))).alias("seq"))


_FORMS = "(VALUES (1, '附件1 投标函'), (2, '致：招标人'), (3, '格式一'), (4, '附件2 授权委托书'), (5, '附 授权人身份证明'), (6, '签字')) AS t(seq, text)"


@query(f"WITH h AS (SELECT *, CASE WHEN starts_with(text, '附') THEN seq END AS starts, nullif(regexp_extract(text, '^附件([0-9]+)', 1), '') AS no FROM {_FORMS}), g AS (SELECT *, max(starts) OVER (ORDER BY seq) AS opens, last_value(no IGNORE NULLS) OVER (ORDER BY seq) AS carried FROM h) SELECT opens, arg_min(carried, seq) AS number, trim(regexp_replace(arg_min(text, seq), '^附(件[0-9]+)?', '')) AS title, count(*) AS lines FROM g WHERE opens IS NOT NULL GROUP BY opens")
def response_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attachments of a chapter: each heading opens one; without a number of its own it has that of the one before."""
    w = Window.partitionBy(F.lit(0)).orderBy("seq")  # the sections of one chapter
    no = F.nullif(F.regexp_extract("text", "^附件([0-9]+)", 1), F.lit(""))
    g = rows(spark, _FORMS).select("seq", "text", F.max(F.when(F.col("text").startswith("附"), F.col("seq"))).over(w).alias("opens"), F.last(no, True).over(w).alias("carried")).where("opens is not null")
    return g.groupBy("opens").agg(F.min_by("carried", "seq").alias("number"), F.trim(F.regexp_replace(F.min_by("text", "seq"), "^附(件[0-9]+)?", "")).alias("title"), F.count("*").alias("lines"))


_WANTED = "(VALUES (1, '8', '授权委托书'), (2, '9', '投标保函'), (3, NULL, '业绩表'), (4, '7', '承诺函'), (5, '6', '身份证明')) AS w(id, no, title)"
_GIVEN = "(VALUES (1, '8', '授权委托书', 3, 90), (2, '8', '法定代表人授权委托书', 1, 80), (3, '9', '保证金凭证', 1, 10), (4, '5', '业绩表', 2, 70), (5, '5', '业绩表汇总', 1, 60), (6, '8-2', '承诺函', 1, 30), (7, '1', '身份证明', 1, 5), (8, '2', '身份证明', 1, 5)) AS g(sec, no, title, pages, size)"


@query(f"WITH p AS (SELECT id, w.no AS wno, sec, g.no = w.no AS numbered, contains(g.title, w.title) OR contains(w.title, g.title) AS titled, (CASE WHEN g.title = w.title THEN 0 ELSE 1 END, pages, size, sec) AS o FROM {_WANTED}, {_GIVEN}), a AS (SELECT id, any_value(wno) AS wno, arg_min(sec, o) FILTER (numbered AND titled) AS exact, count(*) FILTER (numbered) AS numbered, min(sec) FILTER (numbered) AS only_number, count(*) FILTER (titled) AS titled, arg_min(sec, o) FILTER (titled) AS by_title FROM p GROUP BY id) SELECT id, coalesce(exact, CASE WHEN numbered = 1 THEN only_number END, CASE WHEN titled = 1 OR wno IS NULL THEN by_title END) AS sec FROM a")
def attachment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of a bid for each attachment asked for: of its number and title the best, else the only one of its number,
    else the only one of its title (the best, if it has no number). The attachments asked for are few and broadcast."""
    w, g = rows(spark, _WANTED).select("id", F.col("no").alias("wno"), F.col("title").alias("asked")), rows(spark, _GIVEN)
    p = g.join(F.broadcast(w), F.lit(True)).withColumns({"numbered": F.coalesce(F.col("no") == F.col("wno"), F.lit(False)), "titled": F.col("title").contains(F.col("asked")) | F.col("asked").contains(F.col("title"))})
    order = F.struct(F.when(F.col("title") == F.col("asked"), 0).otherwise(1), "pages", "size", "sec")
    best = lambda cond: F.min_by(F.when(cond, F.col("sec")), F.when(cond, order))
    a = p.groupBy("id").agg(F.max("wno").alias("wno"), best(F.col("numbered") & F.col("titled")).alias("exact"), F.count_if("numbered").alias("n"), F.min(F.when(F.col("numbered"), F.col("sec"))).alias("only"), F.count_if("titled").alias("t"), best(F.col("titled")).alias("by_title"))
    return a.select("id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")), F.when((F.col("t") == 1) | F.col("wno").isNull(), F.col("by_title"))).alias("sec"))


_NAMES = "(VALUES (1, '杭州甲乙科技有限公司', '杭州甲乙科技有限公司（盖章）'), (1, '杭州甲乙', '杭州甲乙科技有限公司（盖章）'), (2, '丙丁集团', '某某印章'), (3, '', '某某印章'), (4, NULL, NULL)) AS t(party, name, seal)"


def company_score(name: Column, seal: Column) -> Column:
    """How well a seal names a company: the ratio of the names or the share of the company's signs in the seal, more if the
    one holds the other; 0 if either is empty or null."""
    a, b = signature(F.coalesce(name, F.lit(""))), signature(F.coalesce(seal, F.lit("")))
    signs = lambda x: F.array_distinct(F.split(x, ""))
    overlap = F.size(F.array_intersect(signs(a), signs(b))) / F.size(signs(a))
    held = F.when(a.contains(b) | b.contains(a), 0.35).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.least(F.greatest(ratio(a, b), overlap) + held, F.lit(1.0)))


@query()
def bidder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each party that its seals bear out best."""
    s = rows(spark, _NAMES).select("party", "name", company_score(F.col("name"), F.col("seal")).alias("score")).where(F.col("score") >= NAMED)
    return s.groupBy("party").agg(F.max_by("name", F.struct("score", F.char_length("name"), "name")).alias("name"), F.max("score").alias("score"))
