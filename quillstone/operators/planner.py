"""Rule-based plans of queries, their accuracy, and merged constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X


def plan_queries(queries: DataFrame, categories: DataFrame, key: str = "id", text: str = "query", requested: str = "requested_intent") -> DataFrame:
    """(id, intent, max_price, category): intent and limit by patterns, and the longest category that the query names.

    categories(category): any number of rows, repeated or null ones too; ties in length go to the smaller name. Distinct
    query texts are matched once, so popular queries cost one row.
    """
    names = categories.select(F.col("category").alias("__c")).where("__c is not null and __c <> ''").distinct()
    texts = queries.select(F.col(text).alias("__t")).where("__t is not null").distinct()
    matched = texts.join(names, F.contains(F.lower("__t"), F.lower("__c"))).groupBy("__t").agg(F.min(F.struct((-F.length("__c")).alias("n"), F.col("__c").alias("c"))).alias("m"))
    rows = queries.join(matched, F.col(text) == F.col("__t"), "left")
    return rows.select(F.col(key), X.intent(F.coalesce(F.col(text), F.lit("")), F.col(requested)).alias("intent"), X.budget(F.col(text)).alias("max_price"), F.col("m.c").alias("category"))


def planner_accuracy(cases: DataFrame, plans: DataFrame, key: str = "id") -> DataFrame:
    """(tag, cases, intent, max_price, category, joint): accuracies overall (tag null) and by tag, in one pass over the cases.

    cases(id, expected struct, tags array); cases with null expected are left out.
    """
    both = cases.where("expected is not null").select(F.col(key), "expected", "tags").join(plans, key)
    same = {c: F.col(c).eqNullSafe(F.col(f"expected.{c}")).cast("double") for c in ("intent", "max_price", "category")}
    checked = both.select("tags", *(v.alias(f"ok_{c}") for c, v in same.items()))
    # The overall figure is one more tag of every case.
    spread = checked.withColumn("tag", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("tags"), F.array().cast("array<string>")))))
    joint = F.col("ok_intent") * F.col("ok_max_price") * F.col("ok_category")
    return spread.groupBy("tag").agg(F.count(F.lit(1)).alias("cases"), *(F.avg(f"ok_{c}").alias(c) for c in same), F.avg(joint).alias("joint"))


def tightened(asked: DataFrame, state: DataFrame, key: str = "query_id") -> DataFrame:
    """Arguments that can only tighten the state's constraints: the lower limit, the state's category first, at most 3
    results, and all exclusions of both. asked and state: (key, max_value, category, top_k, excluded)."""
    a, s = asked.alias("a"), state.alias("s")
    none = F.array().cast("array<string>")
    return a.join(s, F.col(f"a.{key}") == F.col(f"s.{key}"), "left").select(
        F.col(f"a.{key}"),
        F.least("a.max_value", "s.max_value").alias("max_value"),
        F.coalesce("s.category", "a.category").alias("category"),
        F.least(F.col("a.top_k"), F.lit(3)).alias("top_k"),
        F.array_union(F.coalesce("a.excluded", none), F.coalesce("s.excluded", none)).alias("excluded"),
    )


def citations(answers: DataFrame, answer: str = "answer", seen: str = "seen", excluded: str = "excluded") -> DataFrame:
    """Adds citations: the seen ids that the answer names in brackets and that aren't excluded, each once, in order."""
    named = F.filter(F.array_distinct(seen), lambda i: F.contains(F.col(answer), F.concat(F.lit("["), i, F.lit("]"))))
    return answers.withColumn("citations", F.array_except(named, F.coalesce(F.col(excluded), F.array().cast("array<string>"))))
