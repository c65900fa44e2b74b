"""Inputs of the registered queries, derived from the test tables."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..session import broadcast_if_small, spread
from ..sources import from_table

CORPUS = "corpus"
#: Extensions of the documents, in turn. All of the first are indexed; the second set
#: is for the queries whose feature is to drop names.
INDEXED_KINDS = ("md", "py", "rs", "txt")
MIXED_KINDS = ("md", "py", "log", "bin")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_path(kinds: tuple[str, ...] = INDEXED_KINDS) -> "F.Column":
    """`lang/doc_<id>.<ext>`; the extension goes round the kinds."""
    names = F.array(*[F.lit(e) for e in kinds])
    ext = F.get(names, F.pmod("doc_id", F.lit(len(kinds))).cast("int"))
    return F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit("."), ext)


def files(
    spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = INDEXED_KINDS
) -> DataFrame:
    """Every document as a file of the folder named by its source."""
    docs = table(spark, sf_dir, "documents")
    return from_table(docs, F.col("source"), _file_path(kinds), F.col("text"))


def corpus(
    spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = INDEXED_KINDS
) -> DataFrame:
    """Every document as a file of one folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), _file_path(kinds))
    return from_table(docs, F.lit(CORPUS), path, F.col("text"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three states of the documents, as their labels would change them.

    1: without the documents labelled toxic. 2: without those of low quality,
    and with those of high quality edited. 3: German files moved, French files
    cut to their first line."""
    labels = broadcast_if_small(table(spark, sf_dir, "labels"))  # or all texts are shuffled
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    low = F.coalesce(F.col("quality"), F.lit(1)) == 0
    high = F.coalesce(F.col("quality"), F.lit(0)) == 1
    edited = F.when(high, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    cut = F.when(F.col("lang") == "fr", F.substring_index(edited, "\n", 1)).otherwise(edited)
    moved = F.when(F.col("lang") == "de", F.concat(F.lit("moved/"), _file_path())).otherwise(
        _file_path()
    )
    source = F.col("source")
    first = from_table(docs.filter(~toxic), source, _file_path(), F.col("text"))
    second = from_table(docs.filter(~low), source, _file_path(), edited)
    third = from_table(docs.filter(~low), source, moved, cut)
    return first, second, third


def hashed(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("folder", "path", ids.content_hash(F.col("content")).alias("hash"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as chunks, five to a file."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.concat(F.lit("set_"), "label").alias("folder"),
        F.concat(F.lit("file_"), F.floor(F.col("vec_id") / 5)).alias("path"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"),
        F.pmod("vec_id", F.lit(5)).cast("int").alias("chunk_index"),
        F.col("embedding").alias("vector"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(Summarizer.mean(array_to_vector("embedding")).alias("mean"))
    )
    return means.select(
        F.col("label").cast("long").alias("query_id"),
        F.lit(None).cast("string").alias("folder"),
        F.lit(0.3).alias("cutoff"),
        vector_to_array("mean").alias("vector"),
    )


def many_vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as twelve requests, with rising cutoffs, every other one to the
    folder of its label only."""
    step = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", step)
    return rows.select(
        (F.col("vec_id") * 12 + F.col("step")).alias("query_id"),
        F.when(F.col("step") % 2 == 1, F.concat(F.lit("set_"), "label")).alias("folder"),
        ((F.col("step") * 5 + 10) / F.lit(100.0)).alias("cutoff"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a request to the one-folder corpus."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(CORPUS).alias("folder"),
        F.lit(None).cast("double").alias("cutoff"),
    )


def folder_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a request to one of the source folders, every
    other one with a cutoff of its own."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.concat(F.lit("src"), F.pmod("item_id", F.lit(20))).alias("folder"),
        F.when(F.pmod(F.col("item_id").cast("int"), F.lit(2)) == 1, 0.5).alias("cutoff"),
    )


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as requests: assistant turns lack the query, system
    turns the folder; later turns set a cutoff."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("query"),
        F.when(F.col("role") != "system", F.lit(CORPUS)).alias("folder"),
        F.when(F.col("turn") > 0, 0.5).alias("cutoff"),
    )
