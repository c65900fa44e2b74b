"""The registered queries: `name -> function(spark, sf_dir) -> DataFrame`."""

from functools import wraps
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EMBEDDING_DIM, TOKENS_PER_CHUNK
from ..functions import ids, paths, text, vectors
from ..operators import ann, chunking, diff, filters, ignore, packing, render, scoring
from ..operators.embedding import (
    FunctionEmbedder, HashedWords, RequestBudget, embed, hashed_words_sparse,
)
from ..plans import CellIndex, FileRules, SearchIndex, answers, search, search_batch, search_with_snippets
from ..plans.index import line_settings, token_settings
from ..session import freeing_shuffles, new_scratch, ship_package, spread
from ..sources import checked, from_binary, scan_directory, valid
from ..streaming import file_changes, start_answers, start_refresh
from ..streaming import requests as request_stream
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Patterns for the ignore queries; the default patterns come before them.
IGNORED = (
    "# generated files",
    "*.bin",
    "src1/",
    "/src2/en",
    "src3/**/doc_*5.md",
    "doc_[0-3]?.py",
    "!doc_1?.py",
    "\\!keep",
)
NEVER_SHOWN = ("src1/", "**/de/")
SMALL_TOKEN_WINDOW = 64
TOKEN_CEILING = 1000
CUSTOM_WINDOW = 500
LETTERS = "aeio"


def register(query: Query) -> Query:
    @wraps(query)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir.rstrip("/"))

    QUERIES[query.__name__] = shipped
    return query


def _shown(files: DataFrame, *more: str) -> DataFrame:
    return files.select(
        "query_id",
        "path",
        vectors.shown(F.col("score")).alias("score"),
        F.col("rank").cast("long").alias("rank"),
        *more,
    )


# -- search over given vectors --------------------------------------------------


def _vector_files(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    top = scoring.top_chunks(
        inputs.vector_chunks(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 64, metric
    )
    # files are the vectors' files, whichever set they come from
    return scoring.best_files(top.withColumn("folder", F.lit("all")))


@register
def search_cosine(spark, sf_dir):
    return _shown(_vector_files(spark, sf_dir))


@register
def search_l2sim(spark, sf_dir):
    return _shown(_vector_files(spark, sf_dir, "l2sim"))


@register
def search_floors(spark, sf_dir):
    """A fifth of the chunks gives every query a floor before all are searched."""
    chunks, queries = inputs.vector_chunks(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    top = scoring.top_chunks(chunks, queries, 64, share=0.2)
    return _shown(scoring.best_files(top.withColumn("folder", F.lit("all"))))


@register
def search_top_chunks(spark, sf_dir):
    top = scoring.top_chunks(
        inputs.vector_chunks(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 64
    )
    return _shown(top, "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@register
def search_many_requests(spark, sf_dir):
    """More requests than one block holds, in one scan of the chunks."""
    top = scoring.top_chunks(
        inputs.vector_chunks(spark, sf_dir), inputs.many_vector_queries(spark, sf_dir), 64
    )
    return _shown(top, "folder", "chunk_id")


@register
def search_batch_per_query_cutoff(spark, sf_dir):
    queries = inputs.vector_queries(spark, sf_dir).select(
        "query_id",
        F.concat(F.lit("set_"), "query_id").alias("folder"),
        F.when(F.pmod("query_id", F.lit(2)) == 1, 0.8).alias("cutoff"),
        "vector",
    )
    defaulted = queries.withColumn("cutoff", F.coalesce("cutoff", F.lit(0.3)))
    top = scoring.top_chunks(inputs.vector_chunks(spark, sf_dir), defaulted, 64)
    return _shown(scoring.best_files(top), "folder")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = inputs.vector_queries(spark, sf_dir).select(
        "query_id", F.concat(F.lit("label "), "query_id").alias("query"), "cutoff"
    )
    return render.ranked_lists(queries, _vector_files(spark, sf_dir))


@register
def search_json(spark, sf_dir):
    return _listed(spark, sf_dir).select("query_id", render.pairs_json(F.col("files")).alias("json"))


@register
def search_json_object(spark, sf_dir):
    body = render.object_json(F.col("query"), F.col("cutoff"), F.col("files"))
    return _listed(spark, sf_dir).select("query_id", body.alias("json"))


@register
def render_prompt(spark, sf_dir):
    return _listed(spark, sf_dir).select("query_id", render.prompt_text(F.col("files")).alias("text"))


@register
def render_add(spark, sf_dir):
    return _listed(spark, sf_dir).select("query_id", render.add_commands(F.col("files")).alias("text"))


# -- vectors --------------------------------------------------------------------


@register
def vector_norms(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@register
def normalize_vectors(spark, sf_dir):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = vectors.to_float(vectors.normalize(doubled))
    rows = inputs.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit))
    return rows.select(
        "vec_id",
        F.col("pos").cast("long").alias("pos"),
        F.round(F.col("col").cast("double"), 6).alias("value"),
    )


@register
def distance_to_mean(spark, sf_dir):
    means = inputs.vector_queries(spark, sf_dir).select(
        F.col("query_id").alias("label"), F.col("vector").alias("mean")
    )
    rows = inputs.table(spark, sf_dir, "embeddings").join(means, "label")
    distance = vectors.squared_distance(F.col("embedding"), F.col("mean"))
    return rows.select(
        "vec_id",
        F.round(vectors.dot(F.col("embedding"), F.col("mean")), 6).alias("dot"),
        F.round(distance, 6).alias("distance"),
        F.round(vectors.similarity_from_distance(distance), 6).alias("similarity"),
    )


# -- files ----------------------------------------------------------------------


@register
def filter_paths(spark, sf_dir):
    rows = inputs.corpus(spark, sf_dir)
    return filters.in_folder(rows, "src1").select("path", "size")


@register
def filter_extension(spark, sf_dir):
    rows = inputs.files(spark, sf_dir, inputs.MIXED_KINDS)
    return rows.filter(filters.is_indexed_name(F.col("path"))).select("folder", "path")


@register
def path_parts(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "path",
        paths.base_name(F.col("path")).alias("base_name"),
        paths.extension(F.col("path")).alias("extension"),
    )


@register
def filter_size(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"))
    return rows.filter(filters.is_indexed_size(F.col("size"), 1000))


@register
def filter_blank(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents")
    # a document without its letters: some are left blank
    bare = F.regexp_replace("text", r"[^\s]+ ?", "")
    kept = rows.select("doc_id", "n_chars", F.when(F.col("lang") == "fr", bare).otherwise(F.col("text")).alias("content"))
    return kept.filter(text.is_not_blank(F.col("content"))).select("doc_id", "n_chars")


def _damaged(content: Column, lang: Column) -> Column:
    """Bytes of a text; the French ones are no longer UTF-8."""
    body = content.cast("binary")
    return F.when(lang == "fr", F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)


@register
def filter_utf8(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    damaged = _damaged(F.col("text"), F.col("lang"))
    kept = from_binary(docs, F.col("source"), F.col("doc_id").cast("string"), damaged)
    return kept.select("folder", "path", "size", F.md5("content").alias("content_md5"))


@register
def rejected_files(spark, sf_dir):
    rows = inputs.files(spark, sf_dir, inputs.MIXED_KINDS)
    content = _damaged(F.col("content"), F.substring_index("path", "/", 1))
    raw = rows.withColumn("content", content).withColumn(
        "size", F.octet_length("content").cast("long")
    )
    return filters.rejected(spread(raw), 20_000, TOKEN_CEILING)


@register
def scan_pages(spark, sf_dir):
    """Every page written to a file of its own, then found by a directory scan."""
    home = new_scratch(spark, "pages")
    pages = inputs.table(spark, sf_dir, "pages").select("html")
    spread(pages).write.option("maxRecordsPerFile", 1).text(home)
    found = scan_directory(spark, home, folder="pages")
    return found.select("folder", "size", F.md5("content").alias("content_md5"))


@register
def relative_path(spark, sf_dir):
    absolute = paths.join_path(F.col("folder"), F.col("path"))
    return inputs.files(spark, sf_dir).select(
        absolute.alias("absolute"),
        paths.relative_path(absolute, F.col("folder")).alias("in_folder"),
        paths.relative_path(absolute, F.lit("src1/en")).alias("in_src1_en"),
    )


@register
def normalize_paths(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?:/", "")
    raw = F.concat(F.lit("file://srv/"), bare, F.lit("/../x/./"), F.col("page_id"))
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", paths.normalize_path(raw).alias("path")
    )


@register
def file_hash(spark, sf_dir):
    return inputs.hashed(inputs.files(spark, sf_dir))


@register
def folder_key(spark, sf_dir):
    key = ids.folder_key(F.col("folder"))
    return (
        inputs.files(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("files"))
        .withColumn("key", key)
    )


@register
def ignore_filter(spark, sf_dir):
    return ignore.filter_ignored(inputs.corpus(spark, sf_dir, inputs.MIXED_KINDS), IGNORED).select("path", "size")


@register
def ignore_defaults(spark, sf_dir):
    nested = inputs.files(spark, sf_dir, inputs.MIXED_KINDS).withColumn(
        "path", F.concat(F.when(F.col("path").startswith("fr/"), "target/").otherwise("lib/"), "path")
    )
    return ignore.filter_ignored(nested).select("folder", "path")


def _pattern_files(snapshot: DataFrame) -> DataFrame:
    """A pattern file for each folder."""
    return snapshot.select("folder").distinct().select(
        "folder",
        F.lit(".gitignore").alias("path"),
        F.when(F.col("folder").endswith("1"), "fr/\n*.py\n!doc_1*.py")
        .otherwise("/en/doc_?.md\n").alias("content"),
        F.lit(20).cast("long").alias("size"),
    )


@register
def ignore_by_folder(spark, sf_dir):
    """The French documents serve as if their folders had a pattern file."""
    rows = inputs.files(spark, sf_dir, inputs.MIXED_KINDS)
    kept = ignore.filter_ignored_by_folder(rows.unionByName(_pattern_files(rows)))
    return kept.filter(F.col("path") != ".gitignore").select("folder", "path")


# -- chunks and tokens ----------------------------------------------------------


@register
def chunk_lines(spark, sf_dir):
    chunked = chunking.with_line_chunks(spread(inputs.files(spark, sf_dir)))
    rows = chunking.explode_chunks(chunked, "folder", "path")
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register
def line_counts(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "pages")
    return rows.select("page_id", text.line_count(F.col("html")).cast("long").alias("lines"))


@register
def chunk_tokens(spark, sf_dir):
    chunked = chunking.with_token_chunks(spread(inputs.files(spark, sf_dir)), SMALL_TOKEN_WINDOW)
    rows = chunking.explode_chunks(chunked, "folder", "path")
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register
def token_counts(spark, sf_dir):
    return spread(inputs.files(spark, sf_dir)).select(
        "folder", "path", text.token_count(F.col("content")).cast("long").alias("n_tokens")
    )


@register
def token_ceiling(spark, sf_dir):
    over = filters.rejected_by_tokens(spread(inputs.files(spark, sf_dir)), TOKEN_CEILING)
    return over.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def _documents_to_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spread(inputs.files(spark, sf_dir)).select(
        "folder", "path", text.token_count(F.col("content")).alias("n_tokens")
    )
    return counted.withColumn("n_chunks", text.chunk_estimate(F.col("n_tokens"), TOKENS_PER_CHUNK))


@register
def chunk_estimate(spark, sf_dir):
    return _documents_to_pack(spark, sf_dir).select(
        "folder", "path", F.col("n_chunks").cast("long").alias("n_chunks")
    )


@register
def pack_batches(spark, sf_dir):
    return packing.pack_requests(packing.with_shards(_documents_to_pack(spark, sf_dir)))


@register
def pack_batches_global(spark, sf_dir):
    """Requests over one sequence of all documents."""
    return packing.pack_in_order(_documents_to_pack(spark, sf_dir))


@register
def batch_sums(spark, sf_dir):
    return packing.request_sums(pack_batches(spark, sf_dir))


@register
def fixed_batches(spark, sf_dir):
    rows = inputs.files(spark, sf_dir).select("folder", "path")
    sharded = packing.with_shards(rows, per_shard=512)
    return packing.fixed_batches(sharded, "shard", ["path", "folder"])


def _chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = chunking.with_line_chunks(spread(inputs.files(spark, sf_dir)))
    return chunking.explode_chunks(chunked, "folder", "path")


@register
def chunk_id_uuid5(spark, sf_dir):
    absolute = paths.join_path(F.col("folder"), F.col("path"))
    return _chunk_keys(spark, sf_dir).select(
        "folder", "path", ids.chunk_id(absolute, F.col("chunk_index")).alias("chunk_id")
    )


@register
def chunk_id_uuid5_hash(spark, sf_dir):
    return _chunk_keys(spark, sf_dir).select(
        "folder", "path", ids.chunk_id_hash_form(F.col("path"), F.col("chunk_index")).alias("chunk_id")
    )


@register
def hashed_embedding_sparse(spark, sf_dir):
    docs = spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return hashed_words_sparse(docs, "doc_id", "text")


class CodePoints:
    """A tokenizer whose tokens are the code points of a text."""

    def encode(self, document: str) -> list[int]:
        return [ord(c) for c in document]

    def decode(self, tokens: list[int]) -> str:
        return "".join(map(chr, tokens))


@register
def chunk_custom_tokens(spark, sf_dir):
    files = spread(inputs.files(spark, sf_dir))
    chunked = chunking.with_tokenizer_chunks(files, CodePoints, CUSTOM_WINDOW)
    rows = chunking.explode_chunks(chunked, "folder", "path")
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _letter_counts(batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    for texts in batches:
        yield np.array([[text.count(c) for c in LETTERS] for text in texts], dtype=np.float64)


@register
def embed_custom(spark, sf_dir):
    """A model of one's own, called within a budget of words."""
    budget = RequestBudget(lambda text: len(text.split()), max_texts=7, max_tokens=20_000)
    model = FunctionEmbedder(_letter_counts, len(LETTERS), "letters", budget)
    docs = spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode(embed(F.col("text"), model)))
    return rows.select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        F.round(F.col("col").cast("double"), 5).alias("value"),
    )


# -- snapshots ------------------------------------------------------------------


def _diff(spark: SparkSession, sf_dir: str, old: int, new: int) -> DataFrame:
    states = inputs.snapshots(spark, sf_dir)
    return diff.snapshot_diff(inputs.hashed(states[old]), inputs.hashed(states[new]))


@register
def snapshot_diff(spark, sf_dir):
    return _diff(spark, sf_dir, 0, 1).select("folder", "path", "status", "old_hash", "new_hash")


@register
def diff_stats(spark, sf_dir):
    return diff.change_stats(_diff(spark, sf_dir, 0, 1))


@register
def delete_paths(spark, sf_dir):
    return diff.paths_to_delete(_diff(spark, sf_dir, 0, 1))


@register
def surviving_files(spark, sf_dir):
    gone = diff.paths_to_delete(_diff(spark, sf_dir, 0, 1))
    return diff.without_paths(inputs.hashed(inputs.snapshots(spark, sf_dir)[0]), gone)


@register
def rename_pairs(spark, sf_dir):
    return diff.rename_pairs(_diff(spark, sf_dir, 1, 2))


@register
def unique_files(spark, sf_dir):
    """A snapshot given twice still counts each file once."""
    rows = inputs.hashed(inputs.files(spark, sf_dir))
    keys = diff.snapshot_keys(rows.unionByName(rows))
    return keys.select("folder", "path", "hash", "copies", F.col("conflict").cast("long").alias("conflict"))


# -- index life cycle -----------------------------------------------------------


def _new_index(spark: SparkSession, label: str, **options) -> SearchIndex:
    return SearchIndex(spark, new_scratch(spark, label), **options)


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "folder", "path", "hash", F.col("chunk_index").cast("long").alias("chunk_index"),
        "chunk_id", "text",
    )


def _three_versions(spark: SparkSession, sf_dir: str, label: str, **options) -> SearchIndex:
    index = _new_index(spark, label, **options)
    first, second, third = inputs.snapshots(spark, sf_dir)
    index.build(first)
    index.refresh(second)
    index.refresh(third)
    return index


@register
def live_after_build(spark, sf_dir):
    index = _new_index(spark, "build")
    index.build(inputs.snapshots(spark, sf_dir)[0])
    return _chunk_rows(index.live_chunks())


@register
def live_after_refresh(spark, sf_dir):
    return _chunk_rows(_three_versions(spark, sf_dir, "refresh").live_chunks())


@register
def embedded_chunks(spark, sf_dir):
    """How many chunks each version embeds, if edits and moves keep known vectors."""
    index = _three_versions(spark, sf_dir, "reuse", reuse_vectors=True)
    return index.run_stats().select(F.col("version").cast("long").alias("version"), "embedded")


@register
def live_after_reuse(spark, sf_dir):
    return _chunk_rows(_three_versions(spark, sf_dir, "kept", reuse_vectors=True).live_chunks())


@register
def live_files(spark, sf_dir):
    index = _three_versions(spark, sf_dir, "files")
    return index.live_files().select("folder", "path", "hash")


@register
def compacted_index(spark, sf_dir):
    index = _three_versions(spark, sf_dir, "compact")
    index.compact()
    return _chunk_rows(index.live_chunks())


@register
def index_inspection(spark, sf_dir):
    return _three_versions(spark, sf_dir, "inspect").inspect()


@register
def index_rejects(spark, sf_dir):
    """What an index of mixed files leaves out: first of short texts only, then of all."""
    rows = inputs.files(spark, sf_dir, inputs.MIXED_KINDS)
    blank = F.when(F.col("path").startswith("fr/"), " \n ").otherwise(F.col("content"))
    index = _new_index(spark, "rejects", rules=FileRules(max_bytes=20_000, defaults=False))
    index.build(spread(rows.filter("size <= 20000")))
    index.refresh(spread(rows.withColumn("content", blank)))
    return index.rejects().withColumn("version", F.col("version").cast("long"))


@register
def run_stats(spark, sf_dir):
    rows = _three_versions(spark, sf_dir, "stats").run_stats()
    return rows.select(F.col("version").cast("long").alias("version"), "added", "modified", "deleted")


def _streamed(spark: SparkSession, sf_dir: str, order: list[int], keyed: bool) -> DataFrame:
    """Chunks of an index that the three snapshots reach as a stream of changes, written
    in the given order."""
    scratch = new_scratch(spark, "stream")
    index = SearchIndex(spark, f"{scratch}/index")
    states = inputs.snapshots(spark, sf_dir)
    for seq in order:
        state = states[seq]
        stored = state.select(
            "folder", "path", "content", F.lit("U").alias("op"), F.lit(seq).cast("long").alias("seq")
        )
        if seq:
            gone = states[seq - 1].join(state, diff.KEY, "left_anti").select(
                "folder", "path", F.lit(None).cast("string").alias("content"),
                F.lit("D").alias("op"), F.lit(seq).cast("long").alias("seq"),
            )
            stored = stored.unionByName(gone)
        with freeing_shuffles(spark):
            stored.write.mode("append").option("compression", "zstd").parquet(f"{scratch}/input")
    stream = file_changes(spark, f"{scratch}/input", files_per_batch=8, consume=True)
    start_refresh(index, stream, f"{scratch}/checkpoint", "changes", keyed=keyed).awaitTermination()
    return _chunk_rows(index.live_chunks())


@register
def stream_refresh(spark, sf_dir):
    """The three snapshots arrive as a stream of changes, compared with what is stored."""
    return _streamed(spark, sf_dir, [0, 1, 2], keyed=False)


@register
def stream_refresh_keyed(spark, sf_dir):
    """The same, compared with the last changes in the stream's state."""
    return _streamed(spark, sf_dir, [0, 1, 2], keyed=True)


@register
def stream_out_of_order(spark, sf_dir):
    """The last snapshot's changes arrive first: what is older changes nothing."""
    return _streamed(spark, sf_dir, [2, 0, 1], keyed=True)


# -- search over texts ----------------------------------------------------------


def _corpus_index(spark: SparkSession, sf_dir: str, label: str, **options) -> SearchIndex:
    index = _new_index(spark, label, **options)
    index.build(inputs.corpus(spark, sf_dir))
    return index


@register
def text_search(spark, sf_dir):
    index = _corpus_index(spark, sf_dir, "search")
    return _shown(search_batch(index, inputs.requests(spark, sf_dir)))


@register
def text_search_by_folder(spark, sf_dir):
    index = _new_index(spark, "folders")
    index.build(inputs.files(spark, sf_dir))
    return _shown(search_batch(index, inputs.folder_requests(spark, sf_dir)), "folder")


@register
def text_search_not_ignored(spark, sf_dir):
    index = _corpus_index(spark, sf_dir, "shown")
    return _shown(search_batch(index, inputs.requests(spark, sf_dir), patterns=NEVER_SHOWN))


@register
def text_search_by_folder_rules(spark, sf_dir):
    """Pattern files written after the build still hide their folder's files."""
    index = _new_index(spark, "ruled")
    snapshot = inputs.files(spark, sf_dir)
    index.build(snapshot)
    found = search_batch(
        index, inputs.folder_requests(spark, sf_dir), pattern_files=_pattern_files(snapshot)
    )
    return _shown(found, "folder")


@register
def text_search_tokens(spark, sf_dir):
    settings = token_settings(HashedWords(EMBEDDING_DIM), size=SMALL_TOKEN_WINDOW)
    index = _corpus_index(spark, sf_dir, "windows", settings=settings)
    return _shown(search_batch(index, inputs.requests(spark, sf_dir)))


@register
def text_search_l2sim(spark, sf_dir):
    settings = line_settings(HashedWords(EMBEDDING_DIM), metric="l2sim")
    index = _corpus_index(spark, sf_dir, "l2sim", settings=settings)
    requests = inputs.requests(spark, sf_dir).withColumn("cutoff", F.lit(0.4))
    return _shown(search_batch(index, requests))


@register
def text_search_default_cutoff(spark, sf_dir):
    """What resembles the first document, at the cutoff of a typed-in query."""
    index = _corpus_index(spark, sf_dir, "typed")
    documents = inputs.table(spark, sf_dir, "documents")
    text_of_first = documents.agg(F.min_by("text", "doc_id")).first()[0]
    return _shown(search(index, text_of_first, inputs.CORPUS))


@register
def search_user_turns(spark, sf_dir):
    index = _corpus_index(spark, sf_dir, "turns")
    return _shown(search_batch(index, inputs.turn_requests(spark, sf_dir)))


@register
def best_snippet(spark, sf_dir):
    index = _corpus_index(spark, sf_dir, "snippet")
    return _shown(search_with_snippets(index, inputs.requests(spark, sf_dir)), "content")


@register
def answers_json(spark, sf_dir):
    index = _corpus_index(spark, sf_dir, "answers")
    return answers(index, inputs.requests(spark, sf_dir))


@register
def stream_answers(spark, sf_dir):
    scratch = new_scratch(spark, "requests")
    index = SearchIndex(spark, f"{scratch}/index")
    index.build(inputs.corpus(spark, sf_dir))
    inputs.requests(spark, sf_dir).repartition(2).write.parquet(f"{scratch}/input")
    stream = request_stream(spark, f"{scratch}/input", files_per_batch=1)
    start_answers(index, stream, f"{scratch}/out", f"{scratch}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{scratch}/out").drop("batch")


@register
def request_checks(spark, sf_dir):
    return checked(inputs.turn_requests(spark, sf_dir))


@register
def request_defaults(spark, sf_dir):
    return valid(inputs.turn_requests(spark, sf_dir)).select("query_id", "folder", "cutoff")


# -- approximate search ---------------------------------------------------------

CELLS = 16


def _celled(spark: SparkSession, sf_dir: str, label: str):
    chunks = inputs.vector_chunks(spark, sf_dir)
    centroids = ann.train_cells(chunks, CELLS)
    return ann.write_cells(chunks, centroids, new_scratch(spark, label)), centroids


@register
def ann_search_all_cells(spark, sf_dir):
    celled, centroids = _celled(spark, sf_dir, "cells")
    top = ann.top_chunks_in_cells(celled, inputs.vector_queries(spark, sf_dir), centroids, CELLS)
    return _shown(scoring.best_files(top.withColumn("folder", F.lit("all"))))


def _given(spark: SparkSession, sf_dir: str):
    """Chunks in cells around the labels' means, which are the queries too."""
    queries = inputs.vector_queries(spark, sf_dir)
    centroids = ann.given_cells(queries.select(F.col("query_id").alias("cell"), "vector"))
    celled = ann.write_cells(
        inputs.vector_chunks(spark, sf_dir), centroids, new_scratch(spark, "given")
    )
    return celled, centroids, queries


@register
def ann_search_given_cells(spark, sf_dir):
    """The labels' means as cells, three of them probed."""
    celled, centroids, queries = _given(spark, sf_dir)
    top = ann.top_chunks_in_cells(celled, queries, centroids, n_probe=3)
    return _shown(scoring.best_files(top.withColumn("folder", F.lit("all"))))


@register
def ann_recall(spark, sf_dir):
    """Share of the exact hits found in the three nearest of the labels' means."""
    celled, centroids, queries = _given(spark, sf_dir)
    found = ann.top_chunks_in_cells(celled, queries, centroids, n_probe=3)
    exact = scoring.top_chunks(inputs.vector_chunks(spark, sf_dir), queries, 64)
    return ann.recall(found, exact).withColumn("recall", F.round("recall", 6))


@register
def ann_bounded(spark, sf_dir):
    """One cell probed, then those that may hold better hits: exact search again."""
    celled, centroids = _celled(spark, sf_dir, "bounded")
    widths = ann.cell_widths(celled, centroids)
    queries = inputs.vector_queries(spark, sf_dir)
    top = ann.top_chunks_bounded(celled, queries, centroids, widths, n_probe=1)
    return _shown(scoring.best_files(top.withColumn("folder", F.lit("all"))))


@register
def ann_text_search_after_refresh(spark, sf_dir):
    """Cells are built before two refreshes and all of them probed, so that the
    result must be that of exact search over the last state."""
    index = _new_index(spark, "celled")
    first, second, third = inputs.snapshots(spark, sf_dir)
    index.build(first)
    cells = CellIndex(index)
    cells.build(CELLS)
    index.refresh(second)
    index.refresh(third)
    found = cells.search_batch(inputs.folder_requests(spark, sf_dir), n_probe=CELLS)
    return _shown(found, "folder")
