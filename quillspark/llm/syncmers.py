"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import copies, cut, table
from quillspark.llm.sharding import FAN, RANGE_ROWS, _range_of

#: Bytes of a k-mer and of the inner substrings whose smallest must lie at an edge. The first and the last inner substring
#: cover a k-mer, so its hash is made of theirs.
K, S = 8, 5
#: Anchors of a fingerprint: of those that fall to a slot the one with the smallest hash.
SLOTS = 32
#: Bytes of a text that are taken at once.
BLOCK = 1 << 16
LAST = 2**63 - 1
#: Places are below 2^31 as Spark's strings are; a slot's value holds 31 bits of the hash above a place.
PLACES = 2**31 - 1


def _places(rows: DataFrame, keep: list[str], k: int = K, s: int = S) -> DataFrame:
    """rows: keep, b (bytes that begin at byte `base` of a text of `whole` bytes). keep, p, h for every place p of b: h is the
    hash of the k-mer there if it is a closed syncmer, that is if the smallest hash of its s-mers is that of the first
    or the last of them, else null; the choice depends on the k-mer alone. Of a text of under k bytes the anchor is all
    of it. The hash of a k-mer that repeats itself at a distance of under n = k - s + 1 bytes is positive, that of any other
    negative: there are few of the former, and a text that consists of one has nothing else, so they come first where
    the smallest is looked for. There is a row at the first place whatever stands there. Long texts are taken in blocks that overlap, so a
    block's places are all that is in memory.

    Nothing is filtered here: a filter would be evaluated with copies of the hashes of which one is enough."""
    n = k - s + 1
    if n < 3 or s < n - 1:
        raise ValueError("a k-mer needs three inner substrings or more, and the first and the last must cover it")
    block = rows.selectExpr(*keep, "b", "base", "whole", f"explode(sequence(0, greatest(octet_length(b) - {k}, 0) div {BLOCK})) as block")
    part = block.selectExpr(*keep, "whole", f"base + block * {BLOCK} as base", f"substring(b, block * {BLOCK} + 1, {BLOCK + k - 1}) as b")
    at = part.selectExpr(*keep, "whole", "base", "b", f"explode(sequence(0, greatest(octet_length(b) - {k}, 0))) as i")
    # substrings are hashed inside the loop that makes the places, in generated code
    hashed = at.selectExpr(*keep, "whole", "octet_length(b) as octets", "base + i as p", "b", *[f"xxhash64(substring(b, i + {j + 1}, {s})) as s{j}" for j in range(n)])
    edge = f"s0 <= least({', '.join(f's{j}' for j in range(1, n))}) or s{n - 1} <= least({', '.join(f's{j}' for j in range(n - 1))})"
    again = " or ".join(f"s0 = s{j}" for j in range(1, n))
    kmer = f"if({again}, xxhash64(s0, s{n - 1}) & {2**63 - 1}L, xxhash64(s0, s{n - 1}) | shiftleft(1L, 63))"
    return hashed.selectExpr(*keep, "p", f"case when octets >= {k} then if({edge}, {kmer}, null) when whole between 1 and {k - 1} then xxhash64(b) | shiftleft(1L, 63) end as h")


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, p, h): all anchors of each whole text, p its byte, for positional matching: texts
    that share a passage share its anchors, at places that differ by a constant. Null and empty texts have none."""
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"), F.lit(0).alias("base"))
    return _places(rows.withColumn("whole", F.octet_length("b")), ["doc_id"], k, s).where("h is not null")


def _sketched(places: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """places: key, carry, p, h, own (the place belongs to the text), edit (it belongs to the edited text, too). key, carry,
    v, v_last, e, e_last: the slots of the text and of the edited text. A slot holds the anchor with the smallest hash among
    those that fall to it: 31 bits of the hash above its first place, and its last place apart."""
    value = "shiftleft(shiftrightunsigned(h, 33), 31)"
    least = [F.expr(f"min(if({x}, {value} + {at}, null))").alias(f"{x}_{name}") for x in ("own", "edit") for name, at in (("first", "p"), ("last", f"({PLACES} - p)"))]
    per = places.withColumn("slot", F.expr(f"h & {SLOTS - 1}")).groupBy(*key, "slot").agg(*[F.max(x).alias(x) for x in carry], *least)
    last = lambda x: (PLACES - F.col(f"{x}_last").bitwiseAND(PLACES)).cast("int").alias(f"{x}_last")
    slots = F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", F.struct("own_first", last("own"), "edit_first", last("edit")).alias("both")))))  # SLOTS entries at most
    found = per.groupBy(*key).agg(*[F.max(x).alias(x) for x in carry], slots.alias("m"))
    return found.select(*key, *carry, *[F.expr(f"transform(sequence(0L, {SLOTS - 1}L), i -> m[i].{x})").alias(name) for x, name in (("own_first", "v"), ("own_last", "v_last"), ("edit_first", "e"), ("edit_last", "e_last"))])


def _slots(x: str) -> Column:
    """The slots that _sketched() packs, as structs of h, first and last; null where no anchor falls."""
    return F.expr(f"transform({x}, (y, i) -> if(y is null, null, named_struct('h', shiftrightunsigned(y, 31), 'first', y & {PLACES}L, 'last', cast({x}_last[i] as bigint))))").alias(x)


def _text(slots: str) -> Column:
    """A fingerprint as text: of each slot its hash, first and last place in hex, the last only if it is another."""
    one = lambda x: F.when(x.isNull(), "").otherwise(F.lower(F.concat_ws(":", F.hex(x["h"]), F.hex(x["first"]), F.when(x["last"] != x["first"], F.hex(x["last"])))))
    return F.array_join(F.transform(slots, one), ",")


def _covered(a: str, b: str, n_a: str, n_b: str) -> str:
    """SQL: the bytes of a's text that a's fingerprint shows to stand in b's, too.

    A slot of a is matched if b's holds the same hash, and then tells the offset between the texts; it is missing in b if
    b's is empty or its hash larger; else nothing is known, as b's smaller anchor may have taken the slot. Between two
    matched places that follow each other at one offset, with no missing anchor between, the texts agree. Both texts'
    starts and ends count as matched places, too, if there are matched anchors at all. After the last place of such a
    stretch the anchor's own K bytes agree."""
    pair = f"filter(arrays_zip({a}, {b}), z -> z.{a} is not null and (z.{b} is null or z.{b}.h >= z.{a}.h))"
    end = f"least(z.{a}.last, z.{b}.last + z.{a}.first - z.{b}.first)"
    same = f"z.{a}.h <=> z.{b}.h"
    two = f"if({same}, array(named_struct('p', z.{a}.first, 'd', z.{a}.first - z.{b}.first), named_struct('p', greatest(z.{a}.first, {end}), 'd', z.{a}.first - z.{b}.first)), array(named_struct('p', z.{a}.first, 'd', cast(null as bigint)), named_struct('p', z.{a}.last, 'd', cast(null as bigint))))"
    ends = f"array(named_struct('p', 0L, 'd', 0L), named_struct('p', {n_a}, 'd', {n_a} - {n_b}))"
    points = f"array_sort(concat(flatten(transform({pair}, z -> {two})), {ends}))"
    start = "named_struct('sum', 0L, 'p', 0L, 'd', cast(null as bigint))"
    gap = f"acc.sum + case when acc.d = x.d then x.p - acc.p when acc.d is not null and acc.p < {n_a} then least({K}L, x.p - acc.p) else 0L end"
    walked = f"aggregate({points}, {start}, (acc, x) -> named_struct('sum', {gap}, 'p', x.p, 'd', x.d), acc -> acc.sum)"
    return f"if(exists(arrays_zip({a}, {b}), z -> z.{a}.h = z.{b}.h), {walked}, 0L)"


def _likeness(a: str, b: str, n_a: str, n_b: str) -> Column:
    """The share of both texts' bytes that stand in the other, by positional matching; two empty texts are alike."""
    return F.expr(f"if({n_a} + {n_b} = 0, 1.0D, ({_covered(a, b, n_a, n_b)} + {_covered(b, a, n_b, n_a)}) / ({n_a} + {n_b}))")


def _following(keys: DataFrame) -> DataFrame:
    """Distinct k to (k, next): the next larger k, after the largest the smallest. Ranges are cut at quantiles; the
    rows of a range are ordered in one task each, and the ranges' first keys (FAN x FAN at most) among themselves."""
    rows = keys.count()
    parts = max(1, min(FAN * FAN // 4, -(-rows // RANGE_ROWS)))
    cuts = sorted(set(keys.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first().q or [])) if parts > 1 else []
    ranged = keys.withColumn("range", _range_of(F.col("k"), cuts))
    firsts = ranged.groupBy("range").agg(F.min("k").alias("first"))
    after = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("after"))
    return ranged.withColumn("next", F.lead("k").over(Window.partitionBy("range").orderBy("k"))).join(F.broadcast(after), "range").selectExpr("k", "coalesce(next, after) as next")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to one row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many of the
    next document's (or all it has); the last document is followed by the first. A fingerprint is SLOTS closed
    syncmers of the UTF-8 bytes with their places; near_* lay two fingerprints over each other and give the share
    of both texts that their anchors show to agree at one offset.

    Texts are shuffled once, by doc_id, and of each next document only the part that is needed once more. Null
    texts count as empty. Null doc_ids come last (as 2^63 - 1). Rows that repeat a doc_id are each
    followed by the next larger doc_id, and its smallest text counts. Other columns are ignored; empty gives empty.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut(base.groupBy("k").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("need"), F.count("*").alias("n")))
    order = cut(_following(sizes.select("k")))
    wanted = order.join(sizes, "k").select(F.col("next").alias("k"), F.col("k").alias("owner"), "need")
    repeated = not sizes.where("n > 1").isEmpty()
    nexts = base.groupBy("k").agg(F.min("text").alias("text")) if repeated else base
    heads = nexts.join(wanted, "k").select(F.col("owner").alias("k"), F.col("k").alias("next"), F.expr("left(text, need)").alias("head"), F.xxhash64("text").alias("next_th"))
    pair = base.join(heads, "k").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("q", F.floor(F.col("n_chars") / 4).cast("int"))
    pair = pair.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - q), left(head, q))"))
    sha = F.sha2(F.col("edited"), 256)
    carry = ["next", "next_th", "n_chars", "size", "size_e", *[f"sha{i}" for i in range(4)]]
    pair = pair.select("k", F.xxhash64("text").alias("th"), "next", "next_th", "n_chars", *[F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)], F.encode("text", "UTF-8").alias("t"), F.encode("edited", "UTF-8").alias("u"), F.octet_length(F.expr("left(text, cast(n_chars as int) - q)")).alias("same"))
    # anchors know no context: those within what stays of the text are the edited text's, too, so of that only the
    # rest is hashed, with the K - 1 bytes before it
    rest = f"greatest(same - {K - 1}, 0)"
    parts = f"explode(array(named_struct('own', true, 'b', t, 'base', 0, 'whole', octet_length(t)), named_struct('own', false, 'b', substring(u, {rest} + 1, octet_length(u)), 'base', {rest}, 'whole', octet_length(u)))) as x"
    pair = pair.selectExpr("k", "th", "same", "next", "next_th", "n_chars", *[f"sha{i}" for i in range(4)], "cast(octet_length(t) as bigint) as size", "cast(octet_length(u) as bigint) as size_e", parts)
    pair = pair.select("k", "th", "same", *carry, "x.*")
    places = _places(pair, ["k", "th", "own", "same", *carry]).withColumn("edit", F.expr(f"not own or p + {K} <= same"))
    one = cut(_sketched(places, ["k", "th"], carry))
    following = one.select(F.col("k").alias("next"), F.col("th").alias("next_th"), F.col("v").alias("f"), F.col("v_last").alias("f_last"), F.col("size").alias("size_f"))
    out = one.join(following, ["next", "next_th"])
    if repeated:
        times = base.groupBy("k", F.xxhash64("text").alias("th")).agg(F.count("*").alias("copies"))
        out = copies(out.join(times, ["k", "th"]), "copies", "copy")
    out = out.select("k", "n_chars", *[f"sha{i}" for i in range(4)], "size", "size_e", "size_f", *map(_slots, "vef"))
    return out.select(
        F.expr(f"nullif(k, {LAST}L)").alias("doc_id"),
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"),
        _text("v").alias("fingerprint"),
        _text("e").alias("edited_fingerprint"),
        _likeness("v", "e", "size", "size_e").alias("near_edited"),
        _likeness("v", "f", "size", "size_f").alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
