"""A training corpus in four stages: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm import best_fit, near_dedup, personal_data
from seekwell.llm import quality as classifier
from seekwell.llm.common import table
from seekwell.llm.queries import tokenizer_path
from seekwell.session import new_scratch, ship_package

NEAR = near_dedup.NearDedup(width=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return classifier.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id.
    Of rows that repeat a doc_id and its text one stays; unlike texts under one id stay
    or go together, as the id does. Documents without an id stay."""
    ship_package(spark)
    found = near_dedup.near_duplicates(docs, NEAR)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    repeated = (
        found.groupBy("doc_id").agg(F.count("*").alias("n"))
        .filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    )
    if repeated.isEmpty():
        return rest
    once = rest.join(repeated, "doc_id", "left_semi")
    key = next(f"_text{i}" for i in range(len(docs.columns) + 1) if f"_text{i}" not in docs.columns)
    once = once.withColumn(key, F.sha2("text", 256)).dropDuplicates(["doc_id", key]).drop(key)
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return personal_data.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 1024 tokens; one row per piece."""
    ship_package(spark)
    # half as many known chunks as alone: executors come here with grown heaps
    return best_fit.pack(docs, tokenizer_path("byte_bpe_50k.json"), 1024, 2, known=560_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("packed", packed),
]

#: The classifier's weights and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        target = new_scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return docs
