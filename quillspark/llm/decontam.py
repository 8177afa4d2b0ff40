"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: Fixed masks by the length of a passage in tokens (from, to): the token offsets that a seed reads; it ignores those
#: between. The masks of a length hit every way to substitute a fifth of its tokens (rounded down), at every length.
MASKS = (
    (1, 1, ((0,),)),
    (2, 2, ((0, 1),)),
    (3, 3, ((0, 1, 2),)),
    (4, 4, ((0, 1, 2, 3),)),
    (5, 9, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))),
    (10, 12, ((0, 1, 2, 4, 5), (0, 1, 2, 5, 6), (0, 1, 3, 5, 6))),
    (13, None, ((0, 1, 2, 4, 5), (0, 2, 4, 5, 6), (0, 1, 2, 4, 6))),
)
#: Share of a passage's tokens that must stand in the document, at the same distances. The masks prove nothing below it.
OVERLAP = 0.8
#: Seeds of passages that are broadcast at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 400_000
#: What separates tokens: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Hashes of a text's lower-cased tokens, in order."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), ""), lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, keep: list[str], ladder) -> DataFrame:
    """rows: keep, w (token hashes). A row for each mask of the ladder and position: keep, p, h. w is read inside the
    loop that makes the rows, whatever of it is not kept is not copied."""
    masks = [(100 * low + i, mask) for low, _, of_length in ladder for i, mask in enumerate(of_length)]
    m = len(masks)
    hashes = " ".join(f"when c % {m} = {i} and c div {m} + {mask[-1]} < size(w) then xxhash64({name}, {', '.join(f'get(w, cast(c div {m} + {o} as int))' for o in mask)})" for i, (name, mask) in enumerate(masks))
    c = rows.where("size(w) > 0").selectExpr(*keep, *([] if "w" in keep else ["w"]), f"explode(sequence(0, {m} * size(w) - 1)) as c")
    return c.selectExpr(*keep, f"cast(c div {m} as int) as p", f"case {hashes} end as h").where("h is not null")


def _in_use(items: DataFrame, masks) -> tuple[list, int]:
    """Of the rungs of the ladder those that some passage's length falls to, and the passages' tokens in all."""
    within = [F.size("iw") >= low if high is None else F.size("iw").between(low, high) for low, high, _ in masks]
    found = items.agg(F.coalesce(F.sum(F.size("iw")), F.lit(0)), *[F.coalesce(F.bool_or(x), F.lit(False)) for x in within]).first()
    return [rung for rung, some in zip(masks, found[1:]) if some], found[0]


def _verified(hits: DataFrame, overlap: float) -> DataFrame:
    """hits: doc_id, w, item_id, iw, d (the passage's start in the document, perhaps outside it)."""
    same = F.expr("size(filter(sequence(0, size(iw) - 1), j -> get(w, d + j) = iw[j]))")
    found = hits.select("doc_id", "item_id", F.size("iw").alias("item_tokens"), same.alias("matched"), F.col("d").alias("start"))
    found = found.where(F.col("matched") >= F.lit(overlap) * F.col("item_tokens") - 1e-9)
    best = found.groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.max("matched").alias("matched"), F.min(F.expr("named_struct('m', -matched, 's', start)")).alias("b"))
    return best.select("doc_id", "item_id", "item_tokens", "matched", (F.col("matched") / F.col("item_tokens")).alias("overlap"), F.col("b.s").alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, overlap: float = OVERLAP, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) to (doc_id, item_id, item_tokens, matched, overlap, start): one
    row for each document and passage of which `overlap` or more stands in the document.

    Each mask reads some tokens of a window and ignores the others, so a substitution at an ignored place
    keeps the seed. Seeds of all positions of all documents are joined with the passages' seeds; around a
    hit, passage and document are laid over each other and all tokens are compared. matched is the best
    number of equal tokens, start the token at which the passage then begins (the first, in a tie). Passages of
    any length count; of one to four tokens all must match. Only masks of lengths that occur are laid on documents.

    The passages' seeds are broadcast only if they are counted to be few; then a document's hits are verified
    where it is read, and no text is shuffled. Otherwise seeds meet in a shuffle and the tokens of
    documents with hits follow in a second one. Case and punctuation do not count. Null and empty
    texts match nothing; rows that repeat a doc_id or item_id are taken together. Other columns are ignored; an empty
    table gives an empty result.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    ladder, n = _in_use(items, masks)
    if not ladder:
        ladder = masks[:1]
    seeds = None
    for low, high, of_length in ladder:
        own = F.size("iw") >= low if high is None else F.size("iw").between(low, high)
        part = _seeds(items.where(own).select("item_id", "iw", F.col("iw").alias("w")), ["item_id", "iw", "w"], [(low, high, of_length)])
        seeds = part if seeds is None else seeds.union(part)
    seeds = seeds.select("item_id", "iw", F.col("p").alias("ip"), "h")
    tok = docs.select("doc_id", F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("w"))
    if n * max(len(x) for _, _, x in ladder) <= broadcast_seeds:
        hits = _seeds(tok, ["doc_id", "w"], ladder).join(F.broadcast(seeds.select("item_id", "ip", "h")), "h").alias("h")
        hits = hits.join(F.broadcast(items.alias("i")), F.col("h.item_id").eqNullSafe(F.col("i.item_id"))).select("doc_id", "w", "h.item_id", "iw", (F.col("p") - F.col("ip")).alias("d"))
        return _verified(hits, overlap)
    met = _seeds(tok, ["doc_id", "th"], ladder).join(seeds.drop("iw"), "h").select("doc_id", "th", "item_id", (F.col("p") - F.col("ip")).alias("d")).distinct().alias("m")
    tok, items = tok.distinct().alias("t"), items.alias("i")
    same = lambda a, b, x: F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
    hits = met.join(tok, same("m", "t", "doc_id") & same("m", "t", "th")).join(items, same("m", "i", "item_id")).select("m.doc_id", "w", "m.item_id", "iw", "d")
    return _verified(hits, overlap)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that contaminated() finds, with all their columns."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct().alias("c")
    return docs.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same rows in SQL: passages laid over documents wherever they have a token in common.
OP4_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS p FROM t),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS p FROM b),
m AS (SELECT doc_id, item_id, n, d.p - i.p AS start, count(*) AS matched FROM d JOIN i USING (token) GROUP BY ALL HAVING count(*) >= 0.8 * n - 1e-9)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_tokens, CAST(matched AS INTEGER) AS matched, matched::DOUBLE / n AS overlap, CAST(start AS INTEGER) AS start
FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""
