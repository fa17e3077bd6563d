"""Metrics of tool-using runs: which share of the cases met what was expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(trace: Column, name: str) -> Column:
    return F.get(trace, F.lit(0))[name]


def run_metrics(runs: DataFrame, tools: list[str]) -> DataFrame:
    """One row of shares over runs, null where there is no case of a kind.

    runs: relevant_ids, returned_ids, expected_ids, citations, expected_citations (arrays of ids); trace, an array of
    (tool, error); expected_tool; answer, expected_fragments; max_price, highest_price (of the hits); latency_ms. tools: the names that
    exist; a call of another tool, or with invalid arguments, is invalid. Empty arrays state no expectation.
    """
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    within = lambda a, b: F.size(F.array_except(a, F.coalesce(b, F.array().cast("array<string>")))) == 0
    share = lambda good, of: F.try_divide(F.count_if(of & good), F.count_if(of))
    every = F.lit(True)
    invalid = F.size(F.filter("trace", lambda t: ~t["tool"].isin(*tools) | F.coalesce(t["error"] == "invalid_arguments", F.lit(False))))
    answered = F.coalesce(F.forall("expected_fragments", lambda x: F.contains(F.col("answer"), x)), F.lit(True))
    kept = F.col("max_price").isNull() | F.col("highest_price").isNull() | (F.col("highest_price") <= F.col("max_price"))
    nearest = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency_ms)")
    return runs.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(has("relevant_ids")).alias("retrieval_cases"),
        share(F.coalesce(F.arrays_overlap("returned_ids", "relevant_ids"), F.lit(False)), has("relevant_ids")).alias("retrieval"),
        share(F.coalesce(_first(F.col("trace"), "tool") == F.col("expected_tool"), F.lit(False)), every).alias("tool"),
        share(kept, every).alias("constraint"),
        share(answered & (~has("expected_ids") | within("expected_ids", F.col("returned_ids"))), every).alias("task"),
        F.avg(F.coalesce(F.size("trace"), F.lit(0))).alias("calls"),
        F.try_divide(F.sum(invalid), F.sum(F.size("trace"))).alias("invalid_calls"),
        F.count_if(has("expected_citations")).alias("citation_cases"),
        share(within("expected_citations", F.col("citations")), has("expected_citations")).alias("citation"),
        share(within("expected_citations", F.col("citations")) & within("citations", F.col("returned_ids")), has("expected_citations")).alias("grounded"),
        nearest(0.5).alias("p50"),
        nearest(0.95).alias("p95"),
    )
