"""Ranked files as JSON documents or text, one row per query.

A query has at most as many files as chunks were searched for, so collecting
them into one array is bounded.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import shown
from ..session import broadcast_if_small, materialize

# Fixed value: the first line of the prompt form.
PROMPT_HEADING = "The relevant data may be in these files:\n"


def ranked_lists(queries: DataFrame, files: DataFrame) -> DataFrame:
    """The query columns plus `files`, an array of (rank, score, path) in rank
    order, empty for queries without hits."""
    grouped = files.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("rank", shown(F.col("score")).alias("score"), "path")
            )
        ).alias("files")
    )
    none = F.array().cast("array<struct<rank:int,score:double,path:string>>")
    return queries.join(grouped, "query_id", "left").withColumn(
        "files", F.coalesce("files", none)
    )


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def pairs_json(files: Column) -> Column:
    """`{"files_by_relevance":[[score,path],...]}`."""
    pair = F.transform(
        files,
        lambda f: F.concat(
            F.lit("["), f["score"].cast("string"), F.lit(","), _json_string(f["path"]), F.lit("]")
        ),
    )
    return F.concat(
        F.lit('{"files_by_relevance":['), F.array_join(pair, ","), F.lit("]}")
    )


def object_json(query: Column, cutoff: Column, files: Column) -> Column:
    """`{"query","cutoff","files_by_relevance":[{"file","relevance"},...]}`."""
    items = F.transform(
        files, lambda f: F.struct(f["path"].alias("file"), f["score"].alias("relevance"))
    )
    return F.to_json(
        F.struct(
            query.alias("query"), cutoff.alias("cutoff"), items.alias("files_by_relevance")
        )
    )


def _lines(files: Column, prefix: str) -> Column:
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit(prefix), f["path"])), "\n")


def prompt_text(files: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEADING), _lines(files, "- "))


def add_commands(files: Column) -> Column:
    return _lines(files, "/add ")


def with_snippets(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds `content`, the text of the best chunk of each file.

    The hits are stored and their distinct keys measured in bytes. Keys that fit are
    sent to the chunk table, so that only texts of hits leave their task."""
    keys = ["folder", "path", "chunk_index"]
    found = materialize(files, "found")
    wanted = broadcast_if_small(found.select(*keys).distinct())
    texts = chunks.select(*keys, F.col("text").alias("content")).join(wanted, keys, "left_semi")
    return found.join(texts, keys).select(
        "query_id", "folder", "path", "score", "rank", "content"
    )
