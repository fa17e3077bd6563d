"""Segments of a catalog by quantiles of a value, by category, or both, with statistics that let queries skip segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.ranking import exact_quantiles


def _inner_edges(quantiles: Column) -> Column:
    edges = F.array_distinct(quantiles)
    return F.when(F.size(edges) > 2, F.slice(edges, F.lit(2), F.size(edges) - 2)).otherwise(F.array().cast("array<double>"))


def _bucket(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def by_value(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds segment: the number of inner quantile edges up to the value. Null values have a null segment."""
    edges = exact_quantiles(rows, value, [i / buckets for i in range(buckets + 1)]).select(_inner_edges(F.col("quantiles")).alias("__edges"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("segment", F.when(F.col(value).isNotNull(), _bucket(F.col("__edges"), F.col(value)))).drop("__edges")


def by_category(rows: DataFrame, category: str) -> DataFrame:
    """Adds segment: the category in lower case."""
    return rows.withColumn("segment", F.lower(category))


def by_category_and_value(rows: DataFrame, category: str, value: str, buckets: int) -> DataFrame:
    """Adds segment: category#bucket, by quantiles within the category."""
    quantiles = F.percentile(F.col(value).cast("double"), F.array(*(F.lit(i / buckets) for i in range(buckets + 1))))
    edges = rows.where(F.col(value).isNotNull()).groupBy(F.lower(category).alias("__c")).agg(_inner_edges(quantiles).alias("__edges"))
    named = rows.join(edges, F.lower(category) == F.col("__c"), "left")
    return named.withColumn("segment", F.concat_ws("#", "__c", _bucket(F.col("__edges"), F.col(value)))).drop("__c", "__edges")


def statistics(rows: DataFrame, value: str, category: str) -> DataFrame:
    """(segment, size, low, high, categories): one row for each segment."""
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("size"), F.min(value).alias("low"), F.max(value).alias("high"), F.sort_array(F.collect_set(F.lower(category))).alias("categories"))


def surviving(stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, segment) that may hold a match of queries(query_id, max_value, category); none that does is left out."""
    may = F.col("max_value").isNull() | (F.col("low") <= F.col("max_value"))
    named = F.coalesce(F.col("category"), F.lit(""))
    may &= (named == "") | F.exists("categories", lambda c: F.contains(c, F.lower(F.col("category"))))
    return stats.join(queries, may).select("query_id", "segment")


def scanned_share(stats: DataFrame, alive: DataFrame) -> DataFrame:
    """(query_id, segments, rows, share): how much of the catalog a query has to read."""
    total = stats.agg(F.sum("size").alias("total"))
    read = alive.join(stats.select("segment", "size"), "segment").groupBy("query_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("rows"))
    return read.crossJoin(F.broadcast(total)).select("query_id", "segments", "rows", F.try_divide(F.col("rows"), F.col("total")).alias("share"))


def is_partition(rows: DataFrame, key: str) -> DataFrame:
    """One row (rows, keys, covered, complete): every key in exactly one segment."""
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.count("segment").alias("covered"))
    return counted.withColumn("complete", (F.col("rows") == F.col("keys")) & (F.col("rows") == F.col("covered")))


def numbered(stats: DataFrame) -> DataFrame:
    """Adds name: label#0000 in the order of segments."""
    return stats.withColumn("name", F.format_string("%s#%04d", F.col("segment").cast("string"), F.row_number().over(Window.orderBy("segment")) - 1))
