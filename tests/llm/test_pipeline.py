"""The pipeline's stages, each held against what its operator says of its own input."""

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from quillspark.llm.decontam import contaminated
from quillspark.llm.langid import FLOOR, identify, learn
from quillspark.llm.simhash import near_duplicates

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_columns_of_documents(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_language(stages):
    said = identify(stages[0], learn(stages[0])).where(f"lang_pred <> 'und' and score >= {FLOOR}")
    assert sorted(r.doc_id for r in stages[1].select("doc_id").collect()) == sorted(r.doc_id for r in said.collect())


def test_near_dedup(stages):
    said = near_duplicates(stages[1]).collect()
    assert sorted(r.doc_id for r in stages[2].select("doc_id").collect()) == sorted({r.component_id for r in said})


def test_decontamination(spark, stages):
    found = {r.doc_id for r in contaminated(stages[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[2:4])
    assert found and after == before - found


def test_mixing_and_sharding(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[3:5])
    times = Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    assert max(times.values()) <= 3 and all(before[d].startswith(t) or t in before[d] for d, t in after.items())
    shards = stages[5].collect()
    assert Counter(r.doc_id for r in shards) == times and len({(r.shard, r.slot) for r in shards}) == len(shards)


def test_run(spark, stages):
    got, want = (sorted((r.doc_id, r.size, r.text_crc32) for r in s.collect()) for s in (corpus_pipeline.run(spark, DATA), stages[5]))
    assert got == want


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.partition("_")[0] for x in names}
    assert set(__spark_entry__.oracle_sql()) <= names
