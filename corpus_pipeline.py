"""Training text in five stages: rules, near-duplicates, benchmark leaks, secrets, mixture."""

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import decontaminate, mixing, quality, secrets, simhash
from ledgerspark.llm.common import stored

# Rules are learned from labels, signatures and forests have no SQL: the stages are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned list go."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*docs.columns)


def near_duplicates(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """One document of each group within 3 bits of 3-word SimHash stays."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Confirmed secrets are masked; every document stays."""
    return secrets.redact(docs, secrets.scan(docs))


def mixture(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """The mix: one row per document and pass, cut at each source's budget."""
    return mixing.emit(mixing.mix(docs))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark_leaks), ("secret scans", secret_scan), ("mixing sources", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
