"""A training corpus from documents: five stages, each one of the operators in ``llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.decontaminate import without_contaminated
from sluiceway.llm.mixing import mixed_documents
from sluiceway.llm.neardup import near_duplicates
from sluiceway.llm.secrets import redact_secrets
from sluiceway.llm.staging import written
from sluiceway.llm.toxicity import learn, without_toxic


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose id is not among the rejected; rows without an id stay."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity, each row by its own text."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    The smallest id of a group stays. Of rows that repeat an id the first by text stays.
    """
    kept = _without(docs, near_duplicates(docs, shingle=5).where("not kept"))
    repeated = kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    # few rows as a rule: only ids that occur twice are put in order
    again = kept.join(repeated, "doc_id", "left_semi")
    order = F.struct(*(F.col(c) for c in kept.columns if c != "doc_id"))
    first = again.groupBy("doc_id").agg(F.min(order).alias("row")).select("doc_id", "row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(
        first.select(docs.columns)
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window, each row by its own text."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; ``n_chars`` counts the new text."""
    redacted = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.length("text").cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

# the first stage learns its model from labels, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
