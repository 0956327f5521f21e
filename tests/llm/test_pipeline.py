"""The pipeline's rows against a plain version of each stage on what the stage before kept."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute_force as passages
from test_ngram_join import brute_force as components
from test_sharding import check as check_shards

from credsieve.llm import quality
from credsieve.llm.common import read, staged
from credsieve.llm.mixing import plan_mix
from credsieve.llm.sharding import SHARD_BYTES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents").cache()
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
    return [f.collect() for f in found]


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(spark, stages):
    columns = read(spark, SF, "documents").columns
    for rows in stages[:-1]:
        assert list(rows[0].__fields__) == columns
    assert set(columns) < set(stages[-1][0].__fields__)


def test_quality_stage(spark, stages):
    verdict = quality.classify(read(spark, SF, "documents"), read(spark, SF, "labels")).collect()
    assert ids(stages[1]) == sorted(r.doc_id for r in verdict if r.kept)


def test_join_stage(stages):
    expected = components([tuple(r) for r in stages[1]])
    assert ids(stages[2]) == sorted({c for _, _, c in expected})


def test_join_stage_takes_five_words_and_four_fifths(spark):
    """100 words with 20 more share 96 of 116 shingles of five words; with 30 more 96 of 126."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:n]), None, None, n) for i, n in enumerate((100, 120, 147))]
    rows += [(10, " ".join(words[200:300]), None, None, 100), (11, " ".join(words[200:330]), None, None, 130)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert ids(corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()) == [0, 10, 11]


def test_benchmark_stage(spark, stages):
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert ids(stages[3]) == sorted(r.doc_id for r in stages[2] if not passages(r.text, items)[1])


def test_mixing_stage(spark, stages):
    plan = plan_mix(spark.createDataFrame(stages[3])).collect()
    assert ids(stages[4]) == sorted(r.row.doc_id for r in plan for _ in range(r.passes))


def test_sharding_stage(stages):
    assert ids(stages[5]) == ids(stages[4])
    check_shards(stages[5], SHARD_BYTES)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert ids(rows) == ids(stages[-1])


def through_all(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = staged(kept)
    return docs, staged(corpus_pipeline.STAGES[-1][1](spark, docs, SF))


def test_messy_rows(spark, clashing):
    docs = clashing.withColumns({"depth": F.lit("d"), "Shard_Rows": F.lit(3), "shard_rows_": F.lit(4)})
    mixed, cut = through_all(spark, docs)
    assert cut.columns == [*docs.columns, "n_bytes", "shard_", "depth_", "shard_bytes", "shard_rows__"]
    assert ids_or_none(cut) == ids_or_none(mixed)
    assert {r.depth for r in cut.select("depth").collect()} == {"d"}
    assert cut.filter("doc_id = 107").first().text == docs.filter("doc_id = 107").first().text


def ids_or_none(frame):
    return sorted(repr(r.doc_id) for r in frame.select("doc_id").collect())


def test_empty_table(spark, no_docs):
    _, cut = through_all(spark, no_docs)
    assert cut.count() == 0 and "shard" in cut.columns
