"""The pipeline against plain versions of its stages."""

import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import decontam, lang_id, mixing, simhash

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, DIR).collect()


def test_rows(spark, documents, result):
    """Exactly the rows that plain applications of the stages keep."""
    model = lang_id.fit(documents, lang_id.learnable())
    identified = {r.doc_id for r in documents.collect() if model.accepts(r.text)}
    groups = {}
    for r in simhash.simhash_groups(documents.where(F.col("doc_id").isin(list(identified)))).collect():
        groups[r.component_id] = min(r.doc_id, groups.get(r.component_id, r.doc_id))
    bad = {r.doc_id for r in decontam.contaminated(documents, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert sorted(r.doc_id for r in result) == sorted(set(groups.values()) - bad)


def test_columns(documents, result):
    assert result[0].__fields__ == [*documents.columns, "position", "shard", "shard_depth"]


def test_language_stage_drops_what_is_in_no_learned_language(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    bad = [
        "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(600)), " ".join(word() for _ in range(120)),
        "\u6211\u4eec\u7684\u76ee\u6807\u662f\u5efa\u7acb\u4e00\u4e2a\u5b8c\u6574\u7684\u5206\u6790\u5f15\u64ce" * 5,
        "\u0411\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0430 \u043f\u0440\u044b\u0433\u0430\u0435\u0442 \u0447\u0435\u0440\u0435\u0437 \u0441\u043e\u0431\u0430\u043a\u0443. " * 4, "123 456 ...", None,
    ]
    more = spark.createDataFrame([(-k, t, None, "s", 0) for k, t in enumerate(bad, 1)], documents.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, documents.unionByName(more), DIR).collect()}
    own = {r.doc_id for r in documents.collect()}
    assert not any(k < 0 for k in kept) and len(kept & own) >= 0.99 * len(own)


def test_mixing_decides_the_positions(spark, documents, result):
    """Without the mixing stage the rows come in another order; with it positions follow the schedule of what it was given."""
    ids = [r.doc_id for r in sorted(result, key=lambda r: r.position)]
    assert [r.position for r in sorted(result, key=lambda r: r.position)] == list(range(len(ids)))
    slots = {r.doc_id: r.slot for r in mixing.mixed(documents.where(F.col("doc_id").isin(ids))).collect()}
    order = [slots[i] for i in ids]
    assert order == sorted(order) and len(set(order)) > 100
    skipped = corpus_pipeline.sharding(spark, documents.where(F.col("doc_id").isin(ids)), DIR)
    assert [r.doc_id for r in skipped.orderBy("position").collect()] != ids


def test_stages_keep_the_schema(spark, documents):
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, DIR).schema == documents.schema, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), DIR).count() == 0, name


def test_odd_rows_pass(spark, documents):
    some = documents.limit(20)
    odd = some.unionByName(some).unionByName(some.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    odd = odd.unionByName(some.limit(1).withColumn("text", F.lit(None).cast("string")))
    odd = odd.unionByName(some.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.expr("repeat(concat(text, ' '), 1000)")}))
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, DIR)
        assert odd.count() > 0
    assert odd.where("doc_id = -5").count() == 1
