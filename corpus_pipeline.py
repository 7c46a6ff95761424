"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``, and extra ones.  Null and empty
texts, texts of any length, ties, repeated rows, null ids and empty tables are treated as
the operators say; none of them makes a stage drop a row but as stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import bpe, decontaminate, line_dedup, minhash
from tracklake.llm import toxicity as tox
from tracklake.llm.queries import tokenizer_path
from tracklake.sources.shared import fresh_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores from which a document is rejected as toxic.
TOXIC = 0.7


def _batches(spark: SparkSession) -> None:
    """Long texts go to Python in smaller Arrow batches than Spark's 10,000 rows: about 3 MB each instead of 30."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below ``TOXIC``; the grammar is learnt from the training part of ``labels``."""
    _batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = tox.fit(docs, labels.where(~tox.held_out()))
    return tox.toxicity(docs, grammar).where(F.col("score") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are like an earlier line; a text of such lines alone becomes empty."""
    _batches(spark)
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    return out.select(
        *[
            (F.when(changed, F.col("kept_text")).otherwise(F.col(c)) if c == "text" else F.when(changed, F.length("kept_text")).otherwise(F.col(c)).cast("bigint") if c == "n_chars" else F.col(c)).alias(c)
            for c in docs.columns
        ]
    )


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the least id of each group of near-duplicates, and those without an id."""
    _batches(spark)
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of ``benchmark``; repeated rows leak alike."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text (null: of the empty text), with whether they decode to it."""
    _batches(spark)
    kept = docs.withColumn("__own", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    ids = bpe.encode(kept, tokenizer_path(), decoded="decoded", keep=["doc_id", "lang", "source", "n_chars", "__own"])
    whole = F.sha2("decoded", 256) == F.col("__own")
    return ids.select("doc_id", "lang", "source", "n_chars", bpe.token_count().alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: The stages cannot be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole of ``documents``."""
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
