import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import mixing
from quillspark.llm.common import copies
from quillspark.llm.mixing import OP5_SQL, mix, mixed, op5_mixing
from tests.oracle import database
from tests.oracle import rows as rows_of

SCHEMA = "doc_id long, text string, source string, size string, target string, n_chars long"


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    total = defaultdict(int)
    for (_, _, s, *_), n in zip(rows, size):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, whole = set(), sum(total.values())
    while True:
        free = [s for s in order if s not in full]
        level = (whole - sum(3 * total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 3 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * total[s] if s in full else weight[s] * level for s in order}
    at, out = defaultdict(int), []
    h = lambda d, n: int(hashlib.md5(f"{d if d is not None else ''}:{n}".encode()).hexdigest()[:15], 16)
    for i in sorted(range(len(rows)), key=lambda i: (h(rows[i][0], size[i]), rows[i][0] is not None, rows[i][0] or 0, size[i])):
        d, _, s, *_ = rows[i]
        taken = sum(max(0, min(size[i], int(target[s] + 0.5) - p * total[s] - at[s])) for p in range(3))
        at[s] += size[i]
        out.append((d, size[i], total[s], round(target[s], 6), taken))
    return sorted(out, key=str), total, target


def rows():
    rng = random.Random(11)
    out = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), rng.choice(["b", "a", "é", "z", "Z"]), "x", None, 1) for i in range(300)]
    out += [(400 + i, "one two three", "tiny", None, None, None) for i in range(2)]
    out += [(500, None, None, None, None, None), (501, "\t \n", None, None, None, None), (502, "a b c d e f", None, None, None, None), (None, "q r", "a", None, None, None)]
    return [*out, out[3], out[3], out[3]]


@pytest.mark.parametrize("bucket_rows", [20_000, 5])
def test_against_brute_force(spark, bucket_rows):
    r = rows()
    got = mix(spark.createDataFrame(r, SCHEMA), bucket_rows=bucket_rows).collect()
    want, total, target = brute(r)
    assert sorted(((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in got), key=str) == want
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.taken <= 3 * x.size
        assert len(x.positions) == -(-x.taken // max(1, x.size)) and (x.position is None) == (x.taken == 0) and x.positions == sorted(x.positions) and all(0 <= p <= 1 for p in x.positions)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in total)


def test_positions_follow_the_schedules(spark):
    r = [(i, "a b c d", s, None, None, None) for i, s in enumerate(["a", "b", "c"] * 400)]
    got = mix(spark.createDataFrame(r, SCHEMA), weights=(1,)).collect()
    early = Counter(x.source for x in got if x.positions and x.positions[0] < 0.5)
    assert early["a"] > early["b"] > early["c"] and abs(early["b"] - 200) < 5 and abs(early["a"] - 250) < 8


def test_the_schedule_decides(spark, monkeypatch):
    """Positions are the inverted integral of the schedule; what is taken follows from them."""
    r = [(i, "a b c d", s, None, None, None) for i, s in enumerate(["a", "b", "c"] * 40)]
    df = spark.createDataFrame(r, SCHEMA)
    for x in mix(df, weights=(1,)).collect():
        tilt = {"a": -0.5, "b": 0.0, "c": 0.5}[x.source]
        share = x.position * (1 + tilt * (x.position - 1))
        assert abs(share * 40 - round(share * 40)) < 1e-9 and x.taken == 4
    monkeypatch.setattr(mixing, "_time", lambda u: f"(0.5 * {u})")
    assert any(x.taken != 4 for x in mix(df, weights=(1,)).collect())


def test_a_row_that_is_repeated_often(spark):
    df = spark.createDataFrame([(1, "a b", "s", None, None, None)], SCHEMA)
    for _ in range(4):
        df = df.unionAll(df).unionAll(df)
    assert [tuple(x) for x in copies(df.groupBy("doc_id").count(), "count", "i", block=7).orderBy("i").collect()] == [(1, 81, i) for i in range(81)]
    assert sum(x.taken for x in mix(df).collect()) == 162


CLASH = "doc_id long, text string, source string, copy string, taken string, time string, at string, row string, position long, m long"


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(i, "a b c", "s", "1", "2", "3", "4", "5", 6, i) for i in range(3)], CLASH)
    got = mixed(df).collect()
    assert mixed(df).columns == df.columns and sorted(map(tuple, got)) == sorted(map(tuple, df.collect()))


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(op5_mixing(spark, sf).toPandas()) == rows_of(database(sf).execute(OP5_SQL).df())


def test_mixed_documents(spark):
    r = [(i, f"a{i}  b\nc d", s, "keep", None, 99) for i, s in enumerate(["a", "b", "c"] * 20)] + [(90, "", "a", "keep", None, 0)]
    df = spark.createDataFrame(r, SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns
    got = out.collect()
    words = Counter()
    for x in got:
        words[x.source] += len(x.text.split())
        assert x.size == "keep" and r[x.doc_id][1].startswith(x.text)
    plan = Counter()
    for x in mix(df).collect():
        plan[x.source] += x.taken
    assert words == plan


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
