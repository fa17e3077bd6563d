"""Lexical retrieval: an inverted index as tables, and BM25.

Indexes are DataFrames, written to Parquet like any other. Queries come as a table; each operator scores all of them in
one plan. Terms that most documents have make the largest groups of the term join; AQE splits them, and scores are
added up before and after the shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.ranking import top_k
from quillstone.session import Files, cut, spread

K1, B = 1.5, 0.75
#: Query terms up to this number are sent to all tasks; more are joined by a shuffle.
FEW_TERMS = 500_000


@dataclass
class Index:
    """postings(term, doc_id, dl, tf), terms(term, df, idf), docs(doc_id, …) and stats(n, avgdl): one row."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Parquet tables and, last, a description in a folder of any file system that Spark reads."""
        for name in ("postings", "terms", "docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        Files(path, self.postings.sparkSession).write(json.dumps({"kind": "bm25", "format": 1}), "index.json")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        if json.loads(Files(path, spark).read("index.json")).get("kind") != "bm25":
            raise ValueError("not a BM25 index")
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "docs", "stats")))


def term_frequencies(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_idf(n: Column, df: Column) -> Column:
    """Always above 0, falling in df."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_terms(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """Postings (doc_id, dl, term, tf), written once.

    Each carries its document's length, so that scoring needs no join of all postings with the documents. They lie
    together by document: one shuffle serves counting and scoring.
    """
    # explode_outer() keeps Spark from adding filters that would make the terms again.
    analysed = spread(docs).select(F.col(key).alias("doc_id"), terms.alias("__terms"))
    exploded = analysed.select("doc_id", F.size("__terms").alias("dl"), F.explode_outer("__terms").alias("term")).where("term is not null")
    return cut(exploded.repartition("doc_id").groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")))


def build_index(docs: DataFrame, key: str, terms: Column, keep: list[str] = ()) -> Index:
    """The index of docs; those without terms count in the averages. keep: columns to carry in docs. Keys are unique."""
    postings = document_terms(docs, key, terms)
    carried = docs.select(F.col(key).alias("doc_id"), *keep)
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = carried.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("n", F.coalesce(F.nullif(F.try_divide("total", "n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    frequent = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = frequent.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    return Index(postings, idf, carried, stats)


def query_terms(queries: DataFrame, key: str, terms: Column) -> DataFrame:
    """(query_id, term, qtf)."""
    return term_frequencies(queries, key, terms).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def bm25_scores(index: Index, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with a query of wanted(query_id, term, qtf)."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 is at least 0 and b between 0 and 1")
    rare = wanted.join(index.terms.select("term", "idf"), "term")
    weight = F.col("tf") * (k1 + 1) / F.greatest(F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")), F.lit(1e-12))
    weighted = index.postings.crossJoin(F.broadcast(index.stats.select("avgdl"))).select("term", "doc_id", weight.alias("w"))
    if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        # With postings together by document, a document's score is added up where it lies, and top-k cuts before any shuffle.
        hits = weighted.repartition("doc_id").join(F.broadcast(rare), "term")
    else:
        hits = rare.join(weighted, "term")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("w") * F.col("qtf")).alias("score"))


def allowed(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """hits(query_id, doc_id, …) that pass their query's filters: max_value (docs.value, inclusive), category (part of
    docs.category, any case; empty is off) and excluded (array of doc_ids). Null filters are off; filters come before any cut."""
    joined = hits.join(docs.select("doc_id", "value", "category"), "doc_id").join(queries.select("query_id", "max_value", F.col("category").alias("q_category"), "excluded"), "query_id")
    fits = F.col("max_value").isNull() | (F.col("value") <= F.col("max_value"))
    fits &= (F.coalesce(F.col("q_category"), F.lit("")) == "") | F.contains(F.lower("category"), F.lower("q_category"))
    return joined.where(fits & ~F.coalesce(F.array_contains("excluded", F.col("doc_id")), F.lit(False))).drop("value", "category", "max_value", "q_category", "excluded")


def bm25_search(index: Index, queries: DataFrame, terms: Column, k: int = 10, tie: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the top k by score (4 decimals), then by the document's column tie (in index.docs)."""
    scores = bm25_scores(index, query_terms(queries, "query_id", terms)).withColumn("score", F.round("score", 4))
    if tie != "doc_id":
        # Few enough rows for a second cut: more than k of a query stay only if they tie at the cut.
        ranked = scores.withColumn("__r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("__r") <= k)
        scores = ranked.drop("__r").join(index.docs.select("doc_id", tie), "doc_id")
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc(tie)], k).select("query_id", "rank", "doc_id", "score")


def searchable(products: DataFrame, row: str = "row_id") -> DataFrame:
    """(doc_id, text, row_id, rating, category, value) of catalog rows."""
    return products.select(F.col("id").alias("doc_id"), X.searchable_text(F.col("title"), F.col("category"), F.col("description"), F.col("attributes")).alias("text"), F.col(row).alias("row_id"), "rating", "category", F.col("price").alias("value"))
