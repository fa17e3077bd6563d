"""Evaluation: ranks, agreement of sets, percentiles, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(ranks: DataFrame, group: list[str] = ()) -> DataFrame:
    """Recall at 1, 5 and 10, MRR and nDCG (of one relevant item) of (…, first_rank): one row for each group; no hit counts as 0."""
    r = F.col("first_rank")
    within = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    return ranks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("cases"), within(1), within(5), within(10), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.avg(F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg_at_10")
    )


def set_recall(pairs: DataFrame, got: str, truth: str) -> DataFrame:
    """One row: the mean share of each truth array that is in got; -1 is no id, rows with empty truth are left out, null if none is left."""
    clean = lambda c: F.array_distinct(F.filter(c, lambda x: x != -1))
    t, g = clean(F.col(truth)), clean(F.col(got))
    return pairs.where(F.size(t) > 0).agg(F.avg(F.size(F.array_intersect(g, t)) / F.size(t)).alias("recall"))


def set_agreement(pairs: DataFrame, got: str, exact: str) -> DataFrame:
    """One row: share of equal sets, mean Jaccard similarity, and how many exact ids are missing."""
    both, either, lost = F.size(F.array_intersect(got, exact)), F.size(F.array_union(got, exact)), F.size(F.array_except(exact, got))
    return pairs.agg(F.avg(F.when((lost == 0) & (F.size(F.array_except(got, exact)) == 0), 1.0).otherwise(0.0)).alias("set_match"), F.avg(F.when(either > 0, both / either).otherwise(1.0)).alias("jaccard"), F.sum(lost).cast("long").alias("missing"))


def latency_summary(rows: DataFrame, group: list[str], value: str, counted: Column | None = None) -> DataFrame:
    """Count, nearest-rank p50, p95 and p99, linear p95, mean and max; counted says which rows' times count."""
    v = F.when(counted if counted is not None else F.lit(True), F.col(value))
    nearest = lambda q: F.expr(f"percentile_disc({q}) within group (order by __v)").alias(f"p{round(q * 100)}")
    return rows.withColumn("__v", v).groupBy(*group).agg(F.count(F.lit(1)).alias("calls"), nearest(0.5), nearest(0.95), nearest(0.99), F.percentile("__v", 0.95).alias("p95_linear"), F.avg("__v").alias("mean"), F.max("__v").alias("max"))


def window_sweep(hits: DataFrame, truth: DataFrame, windows: list[int]) -> DataFrame:
    """(window, recall): share of truth pairs (query_id, doc_id) within each candidate window of hits."""
    sized = truth.select("query_id", "doc_id").distinct().join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    spread = sized.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    return spread.groupBy("window").agg(F.avg(F.when(F.col("rank") <= F.col("window"), 1.0).otherwise(0.0)).alias("recall"))


def margins(scores: DataFrame, near: float = 0.05) -> DataFrame:
    """(query_id, margin, close) of scores(query_id, truth, other): the truth's best score less the best other's; null if one is missing."""
    one = scores.select("query_id", F.round(F.col("truth") - F.col("other"), 4).alias("margin"))
    return one.withColumn("close", F.abs("margin") <= near)


def recall_of_kinds(truth: DataFrame, found: dict[str, DataFrame], least: float) -> DataFrame:
    """(kind, queries, enough): for each kind of search, whether its hits hold the share least of the truth's (query_id, vec_id)."""
    sizes = truth.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("query_id").alias("queries"))
    hits = reduce(DataFrame.unionByName, [f.select(F.lit(kind).alias("kind"), "query_id", "vec_id") for kind, f in found.items()])
    met = hits.join(truth, ["query_id", "vec_id"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("met"))
    kinds = truth.sparkSession.createDataFrame([(k,) for k in found], "kind string")
    return kinds.join(met, "kind", "left").crossJoin(sizes).select("kind", "queries", (F.coalesce("met", F.lit(0)) >= least * F.col("pairs")).alias("enough"))


def load_summary(calls: DataFrame, group: list[str], latency: str, failed: Column, started: str) -> DataFrame:
    """(group, calls, p50, p95, p99, p95_linear, mean, max, errors, rps) of calls: rps is how many a second, from the first start to the
    last end (started in seconds, latency in milliseconds); null if that takes no time."""
    timed = latency_summary(calls, group, latency)
    span = F.max(F.col(started) + F.col(latency) / 1000) - F.min(started)
    rates = calls.groupBy(*group).agg(F.count_if(failed).alias("errors"), F.try_divide(F.count(F.lit(1)), span).alias("rps"))
    return timed.join(rates, group)


def unscored(items: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """The items that have no score yet, so that an interrupted run goes on where it stopped."""
    return items.join(scores.select(key), key, "left_anti")


def best_run(runs: DataFrame, group: list[str], measure: str, tie: str) -> DataFrame:
    """The run of each group with the highest measure; of equal ones that with the lowest tie. A null measure counts as 0."""
    return runs.groupBy(*group).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in group]), F.struct(F.coalesce(measure, F.lit(0)), -F.col(tie))).alias("r")).select(*group, "r.*")


def bootstrap(values: DataFrame, value: str, resamples: int = 2000, seed: int = 20260907) -> DataFrame:
    """One row (mean, low, high): the mean and its 95 % interval over Poisson resamples.

    A row's count in a resample is Poisson(1); that of n rows of equal value together, Poisson(n). So each distinct value draws
    once for each resample, seeded by the value: no task needs all rows and the result is the same on any cluster.
    """

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, total = np.zeros(resamples, np.int64), np.zeros(resamples)
            for v, n, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = np.random.default_rng(at & ((1 << 64) - 1)).poisson(n, resamples)
                drawn += counts
                total += counts * v
            yield pa.record_batch([pa.array(np.arange(resamples)), pa.array(drawn), pa.array(total)], names=["b", "n", "s"])

    equal = values.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    drawn = equal.select("v", "n", F.xxhash64("v", F.lit(seed)).alias("at")).mapInArrow(draw, "b long, n long, s double")
    means = drawn.groupBy("b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return values.agg(F.avg(value).alias("mean")).crossJoin(interval)
