import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillspark.llm import sharding
from quillspark.llm.sharding import DOC_BITS, shard

SCHEMA = "doc_id long, text string, size string, shard string, key long"


def check(rows, got, shards, near):
    """The law: gapless slots, sizes near equal, rows kept; returns each text's shards."""
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, sizes, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - fair) <= near for s in range(shards))
    return where


def many():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 200))), None, "x", 0) for i in range(600)]
    return rows + [(1000 + i, rows[i % 40][1], None, "y", 1) for i in range(80)]


@pytest.mark.parametrize("slot_rows", [50_000, 40])
def test_sizes_are_near_equal_and_groups_whole(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(sharding, "SLOT_ROWS", slot_rows)
    got = shard(spark.createDataFrame(many(), SCHEMA), shards=6).collect()
    where = check(many(), got, 6, 250)
    assert sum(len(s) > 1 for s in where.values()) <= 5  # of groups only those in which a shard ends


def test_splitters_decide(spark, monkeypatch):
    """The shard of a record is the number of splitters at or below its key, whatever the splitters are; without any, all is
    one shard."""
    rows, key = many(), lambda d, t: (int(hashlib.md5((t or "").encode()).hexdigest()[:10], 16) << DOC_BITS) + int(hashlib.md5(str(d).encode()).hexdigest()[:5], 16)
    df, real, seen = spark.createDataFrame(rows, SCHEMA), sharding.splitters, []
    monkeypatch.setattr(sharding, "splitters", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {(r.doc_id, r.text_crc32): r.shard for r in shard(df, shards=6).collect()}
    assert len(seen[0]) == 5
    assert got == {(d, zlib.crc32(t.encode())): bisect.bisect_right(seen[0], key(d, t)) for d, t, *_ in rows}
    monkeypatch.setattr(sharding, "_quantiles", lambda *a: [])
    assert {r.shard for r in shard(df, shards=6).collect()} == {0}


def test_small_samples_are_subdivided(spark, monkeypatch):
    """With few sampled keys a range the first ranges are uneven; those that are overfull are cut again."""
    monkeypatch.setattr(sharding, "SAMPLE", 1)
    rows = many() * 3
    check(rows, shard(spark.createDataFrame(rows, SCHEMA), shards=4).collect(), 4, 1200)


def test_a_group_that_holds_most_is_divided(spark):
    rows = [(i, "the same text " * 5, None, None, None) for i in range(400)] + [(500 + i, f"text {i}", None, None, None) for i in range(100)]
    where = check(rows, shard(spark.createDataFrame(rows, SCHEMA), shards=5).collect(), 5, 250)
    assert max(map(len, where.values())) >= 3


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "", None, None, None), (1, "a", None, None, None)] + [(7, "again", None, None, None)] * 50 + [(9, "long " * 100_000, None, None, None)]
    got = shard(spark.createDataFrame(rows, SCHEMA), shards=3).collect()
    check(rows, got, 3, 500_000)


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []
