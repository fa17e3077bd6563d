"""Top-k and ranks with a fixed order for ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(hits: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column = 10, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1. order should end in a unique key; k may be a column.

    Spark keeps only k rows of a group in each task before it shuffles when k is a number.
    """
    limit = F.lit(k) if isinstance(k, int) else k
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= limit)


def first_relevant_rank(hits: DataFrame, truth: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, first_rank): rank of the first relevant hit of each query in truth; null if none was hit."""
    best = hits.join(truth.select(*keys, item).distinct(), [*keys, item]).groupBy(*keys).agg(F.min("rank").alias("first_rank"))
    return truth.select(*keys).distinct().join(best, list(keys), "left")


def interleave(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Round robin over groups: the first of each group, then the second, and so on; adds place (from 1) and turn."""
    numbered = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    # One counter over all rows: numbered within range partitions, so that no task sees them all.
    return with_row_number(numbered, [F.col("turn"), F.col(group).asc_nulls_first()], "place")


def with_row_number(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Numbers all rows from 1 in an order (unique keys at its end), by range partitions and their sizes."""
    return with_running_sum(rows, order, F.lit(1), name)


def with_running_sum(rows: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of the weights up to each row in an order (unique keys at its end), by range partitions and their sums."""
    ranged = rows.withColumn("__w", weight).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__n", F.sum("__w").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sizes = local.groupBy("__part").agg(F.sum("__w").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__n")).drop("__part", "__n", "__before", "__w")


def exact_quantiles(rows: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """One row (quantiles): the exact quantiles of a column, interpolated between neighbours; null values don't count, and without
    others the array is empty.

    Equal values are counted first, then placed by range partitions, so no task holds all values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = with_running_sum(counted, [F.col("v")], F.col("n"), "end")
    wanted = placed.agg(F.max("end").alias("total")).where("total > 0").select(F.posexplode(F.transform(F.array(*map(F.lit, fractions)), lambda q: q * (F.col("total") - 1))).alias("i", "at"))
    near = wanted.select("i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("place")).distinct()
    found = placed.join(F.broadcast(near), (F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
    share = F.when(F.col("place") == F.floor("at"), F.floor("at") + 1 - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    each = found.groupBy("i").agg(F.sum(F.col("v") * share).alias("q"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same keys and seed: those with the lowest hashes."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
