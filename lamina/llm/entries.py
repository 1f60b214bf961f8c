"""The operators on the tables of a data directory, whole and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import ann, html, jaccard, langid, mixing, packing, quality, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(_table(spark, sf_dir, "documents"), quality.grades_of(_table(spark, sf_dir, "labels")))


def op3_html_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labelled_urls(pages, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_quality_ordinal, op3_html_template_removal, op4_hnsw_neighbours, op5_ngram_jaccard_join, op6_pareto_mixing, op7_toxic_segments, op8_language_kernel, op9_window_packing,
        op10_url_trees,
    )
}

_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

ORACLES: dict[str, str] = {"op1_exact_topk": _TOP_K, "op5_ngram_jaccard_join": jaccard.ORACLE, "op6_pareto_mixing": mixing.ORACLE}
