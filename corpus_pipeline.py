"""From raw documents to a training mix in five stages, each written as Parquet and read by the next.

quality rules drop documents; of every group of near duplicates one document stays; documents that hold a
benchmark item go; personal data is replaced by its kind; the rest is mixed by source.  Benchmark
and labels are read from sf_dir.  Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize
from tidewater.llm.decontam import drop_contaminated
from tidewater.llm.mixing import mix_sources
from tidewater.llm.ngram_join import one_of_each
from tidewater.llm.pii import redact
from tidewater.llm.quality import keep_good

#: Where SQL can't express a stage: the learned cutoffs, the tagger and the drawn mix.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: what the mix takes of it, and in which shards."""
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "placements")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontaminate), ("PII", pii), ("mixing sources to target weights", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
