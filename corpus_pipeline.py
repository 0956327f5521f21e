"""The corpus pipeline: five stages, each written as Parquet before the next one reads it.

Defined cases, stage by stage as in the operators: null and empty texts weigh 0 for the classifier, are linked with
nothing, hold no passage, take part in the mix with no words and go to a shard like others; repeated rows are one
document to the join and the mix counts those left; texts of any length are taken whole; an empty table passes through
all stages. Extra columns stay in all stages. A column of a document that is named like one of the shard's keeps its
name, and the shard's takes an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm.common import read, staged
from credsieve.llm.decontaminate import decontaminate
from credsieve.llm.mixing import mix
from credsieve.llm.ngram_join import keep_one
from credsieve.llm.quality import select_good
from credsieve.llm.sharding import shard

#: Words of a shingle of the near-duplicate stage, and the similarity in hundredths from which on texts
#: are copies. The query op5_ngram_join has its own.
SHINGLE_WORDS = 5
SIMILARITY = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return select_good(docs, read(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them, in training order."""
    return mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each goes to."""
    taken, added = {c.lower() for c in docs.columns}, []
    for name in ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows"):
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        added.append(F.col(name).alias(free))
    return shard(docs).select("row.*", *added)


#: In order. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_benchmark),
    ("source mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Hashed n-gram models and graph components are beyond plain SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
