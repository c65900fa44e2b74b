"""The registered queries of the operators, with production parameters, on whole
tables; and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (
    best_fit, cross_polytope, hard_negatives, near_dedup, personal_data, pieces, pseudo_likelihood,
    quality, shards, token_counts, tree_forest, url_filter, whitening,
)
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; the same on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = (
    url_filter.Rule("org", "/", True),
    url_filter.Rule("example.org", "/es/", False),
    url_filter.Rule("example.org", "/en/1", False),
    url_filter.Rule("com", "/fr/", True),
    url_filter.Rule("com", "/de/", False),
)
NEAR = near_dedup.NearDedup(width=3, percent=85)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 2)


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cross_polytope.neighbours(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 16)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), 40)


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _shipped(q)
    for q in (
        op1_url_filter, op2_sentencepiece, op3_personal_data, op4_best_fit_packing,
        op5_pseudo_likelihood, op6_token_counts, op7_nearest_neighbours, op8_quality,
        op9_near_dedup, op10_near_vectors, op11_hard_negatives, op12_whitening, op13_shards,
    )
}

ORACLES: dict[str, str] = {
    "op10_near_vectors": """
WITH RECURSIVE good AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM good UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
numbers AS (SELECT a AS vec_id, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN component USING (vec_id) LEFT JOIN numbers USING (vec_id)""",
    "op11_hard_negatives": """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
}
