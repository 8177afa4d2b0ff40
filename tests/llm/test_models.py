"""The trained operators, on held-out rows and at the edges."""

import random
import zlib

import numpy as np
import pytest

from quillspark.llm import langid, quality

DATA = "/root/testdata/sf0.01"


def test_network_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    n, t, rows = 3, 5, 4
    w, u = rng.normal(0, 0.5, (256, 3 * n)), rng.normal(0, 0.5, (n, 3 * n))
    x, weight = rng.integers(0, 256, (t, rows)), rng.normal(size=(t, rows, n))

    def loss(w, u, back):
        h, total = np.zeros((rows, n)), 0.0
        for i in range(t)[:: -1 if back else 1]:
            h = langid._gates(w[x[i]], h, u, n)[3]
            total += (h * weight[i]).sum()
        return total

    for back in (False, True):
        states = langid._run(x, w, u, back).astype(float)
        gw, gu = langid._back(x, states, weight, w, u, back)
        for which, grad in ((w, gw), (u, gu)):
            for at in [(int(x[1, 1]) if which is w else 1, j) for j in range(3 * n)]:
                e = np.zeros_like(which)
                e[at] = 1e-5
                a, b = ((loss(w + s * e, u, back) if which is w else loss(w, u + s * e, back)) for s in (1, -1))
                assert abs((a - b) / 2e-5 - grad[at]) < 1e-3


def test_fast_scoring_is_the_network():
    rng = random.Random(0)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 31, 32, 127, 128, 129, 160, 500)] + [b""]
    model = langid.train([(t, "ab"[i % 2]) for i, t in enumerate(texts) if t])
    got = langid.pooled(model, texts)
    for t, p in zip(texts, got):
        total = np.zeros(2)
        for at in range(0, len(t), langid.WINDOW):
            stop, before = min(len(t), at + langid.WINDOW), max(0, at - langid.CONTEXT)
            codes = lambda a, b: np.frombuffer(t[a:b], np.uint8)[:, None]
            ahead = langid._run(codes(before, stop), model["w0"], model["u0"], False)[at - before :]
            back = langid._run(codes(at, stop + langid.CONTEXT), model["w1"], model["u1"], True)[: stop - at]
            total += langid._probabilities(np.concatenate([ahead, back], -1), model["v"], model["b"])[:, 0].sum(0)
        assert np.allclose(p, total / max(1, len(t)), atol=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == docs.count() and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    rows = [(i, "abc the " * 9, "en", None, None) for i in range(8)] + [(10 + i, "été où " * 9, "fr", None, 1) for i in range(8)]
    odd = [(30, None, "en", "", 0), (31, "", "fr", "", 0), (32, "12 34 !?", None, "", 0), (None, "the abc", None, None, None), (33, "été " * 200_000, None, None, None), (33, "the", None, None, None)]
    docs = spark.createDataFrame(rows + odd, schema)
    model = langid.learn(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows + odd) and {r.doc_id for r in got if r.lang_pred == "und"} == {30, 31, 32}
    kept = langid.identified(docs, model)
    said = langid.identify(docs, model).where("lang_pred <> 'und' and score >= 0.4")
    assert kept.columns == docs.columns and kept.count() == said.count() and langid.identified(docs, model, 0.0).count() == len(rows + odd) - 3
    assert langid.identified(docs, model, 1.01).isEmpty()
    none = spark.createDataFrame([(1, "text", None, None, None)], schema)
    assert [(r.lang_pred, r.score) for r in langid.identify(none, langid.learn(none)).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), langid.learn(docs.limit(0))).collect() == []


def test_training_windows_are_of_the_whole_text(spark, monkeypatch):
    """Only the end of each text differs between languages, far behind its beginning."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, seed=7: seen.extend(windows) or {"langs": []})
    langid.learn(spark.createDataFrame([(i, "a" * 30_000 + "b" * 30_000, "en") for i in range(20)], "doc_id long, text string, lang string"))
    assert {len(w) for w, _ in seen} == {langid.SPAN} and 0 < sum(w == b"b" * langid.SPAN for w, _ in seen) < len(seen)


def test_statistics_against_plain_python():
    rng = random.Random(1)
    texts = ["", " \n", "a", "é!", "aa aa b", " lead 1.5, X\n"] + [" ".join(rng.choice(["the", "abcdefghijk", "abcdefghijl", "12345678-abcd-12345678", "12345678-abce-12345678", "é", "x#", "1,2", "A|B", "y" * 1500]) for _ in range(80)) for _ in range(5)]
    got = dict(zip(quality.STATS, quality.measure([t.encode() for t in texts]).T))
    for i, t in enumerate(texts):
        b, w = t.encode(), [x for x in t.replace("\n", " ").split(" ") if x]
        per = max(1, len(w))
        assert np.isclose(got["log_bytes"][i], np.log1p(len(b))) and np.isclose(got["log_words"][i], np.log1p(len(w)))
        for name, members in quality.CLASSES.items():
            assert np.isclose(got[f"{name}_share"][i], sum(x in members for x in b) / max(1, len(b)))
        assert np.isclose(got["word_bytes"][i], sum(len(x.encode()) for x in w) / per)
        assert got["longest_word"][i] == max((len(x.encode()) for x in w), default=0)
        assert np.isclose(got["repeated_next"][i], sum(x == y for x, y in zip(w, w[1:])) / per)
        assert np.isclose(got["distinct_words"][i], len(set(w)) / per)
        assert np.isclose(got["top_word"][i], max(map(w.count, w), default=0) / per)


def test_quality_of_held_out_documents(spark):
    got = quality.op1_quality(spark, DATA).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_rules_run_as_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.STATS)))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = quality.fit(x, y)
    want = 1 / (1 + np.exp(-(model["base"] + sum(w * quality._holds(x, r) for r, w in model["rules"]))))
    assert 0 < len(model["rules"]) and ((want > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["doc_id", *quality.STATS])
    got = {r.doc_id: r.s for r in df.select("doc_id", quality.compiled(model).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


@pytest.mark.parametrize("known", [[], [(1, 1, 0), (2, None, 0), (None, 1, 0), (99, 0, 1)]])
def test_quality_edges(spark, known):
    docs = [(1, "a b", "x", 1), (2, None, None, None), (None, "", None, None), (3, "z" * 500_000, None, None), (3, "z", None, None)]
    got = quality.score(spark.createDataFrame(docs, "doc_id long, text string, score string, quality long"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, 3, None] and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect() == []
