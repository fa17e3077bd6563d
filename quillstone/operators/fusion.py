"""Fusion of ranked routes and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.records import reasons
from quillstone.operators.ranking import top_k


def score_fusion(lexical: DataFrame, semantic: DataFrame, weight: float = 0.65) -> DataFrame:
    """(query_id, doc_id, score): weight x lexical + (1 - weight) x semantic over the union of both; a missing score is 0."""
    if not 0 <= weight <= 1:
        raise ValueError("weight lies between 0 and 1")
    both = lexical.select("query_id", "doc_id", F.col("score").alias("l")).join(semantic.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", F.round(weight * F.coalesce("l", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0)), 4).alias("score"))


def hybrid(queries: DataFrame, text: DataFrame, image: DataFrame, docs: DataFrame, k: int = 10, weight: float = 0.65) -> DataFrame:
    """(query_id, rank, doc_id, score, text_score, image_score, reasons) of a weighted text and image search.

    queries: query_id, has_text, has_image, max_value, category, excluded. text and image: (query_id, doc_id, score) of all documents with a
    score above 0; a negative one counts as 0. docs: doc_id, row_id, rating, value, category. A query with both has weight x text +
    (1 - weight) x image, one with an image alone its score, one with text alone weight x its score. One with neither ranks by
    rating / 5. Ties go to the higher rating, then to the lower row. Filters come before the cut.
    """
    either = text.select("query_id", "doc_id", F.col("score").alias("t")).join(image.select("query_id", "doc_id", F.greatest("score", F.lit(0.0)).alias("i")), ["query_id", "doc_id"], "full_outer")
    limits = queries.select("query_id", "has_text", "has_image", "max_value", F.col("category").alias("q_category"), "excluded")
    found = either.join(limits.where("has_text or has_image"), "query_id").join(docs, "doc_id")
    # Without a condition there is one order of all documents, and filters only leave some out.
    rated = docs.join(limits.where("not has_text and not has_image"), F.lit(True)).select("query_id", "doc_id", F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("i"), *limits.columns[1:], *[c for c in docs.columns if c != "doc_id"])
    whole = found.unionByName(rated.select(*found.columns))
    fits = (F.col("max_value").isNull() | (F.col("value") <= F.col("max_value"))) & ((F.coalesce("q_category", F.lit("")) == "") | F.contains(F.lower("category"), F.lower("q_category")))
    fits &= ~F.coalesce(F.array_contains("excluded", F.col("doc_id")), F.lit(False))
    t = F.when(F.col("has_text"), F.coalesce("t", F.lit(0.0))).otherwise(0.0)
    i = F.when(F.col("has_image"), F.coalesce("i", F.lit(0.0))).otherwise(0.0)
    part = F.when(F.col("has_text"), 1 - weight).otherwise(1.0)
    score = F.when(F.col("has_text") | F.col("has_image"), weight * t + part * i).otherwise(F.col("rating") / 5)
    scored = whole.where(fits).select("query_id", "doc_id", "row_id", "rating", "max_value", F.round(F.round(score, 9), 4).alias("score"), F.round(t, 4).alias("text_score"), F.round(i, 4).alias("image_score"))
    return first_hybrid(scored, k)


def first_hybrid(scored: DataFrame, k: int) -> DataFrame:
    """The result of hybrid() by scored(query_id, doc_id, row_id, rating, max_value, score, text_score, image_score)."""
    ranked = top_k(scored, ["query_id"], [F.desc("score"), F.desc_nulls_last("rating"), F.asc_nulls_last("row_id")], k)
    return ranked.select("query_id", "rank", "doc_id", "score", "text_score", "image_score", reasons(F.col("text_score"), F.col("image_score"), F.col("max_value")).alias("reasons"))


def union_routes(routes: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """(query_id, doc_id, rank, route, weight) of all routes."""
    weights = weights or [1.0] * len(routes)
    if not routes or len(weights) != len(routes) or min(weights) <= 0:
        raise ValueError("at least one route, and a weight above 0 for each")
    return reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank").withColumns({"route": F.lit(i), "weight": F.lit(float(w))}) for i, (r, w) in enumerate(zip(routes, weights))])


def rrf(routes: list[DataFrame], k: int = 10, rrf_k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, routes): reciprocal-rank fusion of ranked routes, sum of weight / (rrf_k + rank).

    Ties go to the document that an earlier route ranks first; the score (6 decimals) is rounded after ranking.
    """
    if rrf_k < 1:
        raise ValueError("rrf_k is at least 1")
    fused = union_routes(routes, weights).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("s"), F.min(F.struct("route", "rank")).alias("seen"), F.count(F.lit(1)).alias("routes"))
    ranked = top_k(fused, ["query_id"], [F.desc(F.round("s", 12)), F.asc("seen"), F.asc("doc_id")], k)
    return ranked.select("query_id", "rank", "doc_id", F.round("s", 6).alias("score"), "routes")


def route_statistics(routes: list[DataFrame]) -> DataFrame:
    """(route, hits, queries) for each route."""
    return union_routes(routes).groupBy("route").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query_id").alias("queries"))


def rerank(coarse: DataFrame, score: Column, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): coarse(query_id, doc_id, rank, …) in the order of a score column (4 decimals; a
    missing one is last), ties in the coarse order."""
    scored = coarse.withColumnRenamed("rank", "coarse_rank").withColumn("score", F.coalesce(F.round(score, 4), F.lit(float("-inf"))))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("coarse_rank")], k).select("query_id", "rank", "doc_id", "score")


def rerank_by_table(coarse: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """rerank() by scores(query_id, doc_id, table_score)."""
    return rerank(coarse.join(scores, ["query_id", "doc_id"], "left"), F.col("table_score"), k)


def rerank_by_model(coarse: DataFrame, query: str, document: str, score: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """rerank() by a pair scorer that gets batches of texts; the wrong number of scores leaves a batch in its coarse order."""

    def run(q: pa.Array, d: pa.Array) -> pa.Array:
        out = list(score(q.fill_null("").to_pylist(), d.fill_null("").to_pylist()))
        return pa.array(out if len(out) == len(q) else [0.0] * len(q), pa.float64())

    model = F.arrow_udf(run, "double")
    return rerank(coarse.withColumn("__model", model(F.col(query), F.col(document))), F.col("__model"), k)


def overlap_scorer(queries: Iterable[str], documents: Iterable[str]) -> list[float]:
    """A deterministic pair scorer: the share of a query's words that the document has."""
    out = []
    for q, d in zip(queries, documents):
        words = set(q.lower().split())
        out.append(len(words & set(d.lower().split())) / len(words) if words else 0.0)
    return out
