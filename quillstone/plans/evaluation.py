"""Queries of retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import evaluate, lexical, packed
from quillstone.operators.ranking import first_relevant_rank, top_k
from quillstone.plans.registry import query
from quillstone.plans.retrieval import INDEX, named, packed_index
from quillstone.plans.text import terms_sql
from quillstone.session import table

# Self-retrieval: the titles of every row whose number is divisible by 20, against all rows.
SELF = f"""with {INDEX}, asked as (select row_id as query_id, title as query, category, id from products where row_id % 20 = 0 and title is not null),
wanted as (select query_id, term, count(*) as qtf from (select query_id, unnest({terms_sql('query')}) as term from asked) group by all),
scores as (select w.query_id, p.doc_id, round(sum(t.idf * w.qtf * p.tf * 2.5 / greatest(p.tf + 1.5 * (0.25 + 0.75 * len(d.terms) / s.avgdl), 1e-12)), 4) as score
  from wanted w join terms t using (term) join postings p using (term) join docs d on d.doc_id = p.doc_id cross join stats s group by w.query_id, p.doc_id),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, row_id) as rank, doc_id from scores join docs using (doc_id)),
ranks as (select a.query_id, a.category, (select min(rank) from ranked r where r.query_id = a.query_id and r.doc_id = a.id and rank <= 10) as r from asked a)"""
METRICS = """count(*) as cases, round(avg(case when r <= 1 then 1.0 else 0.0 end), 6) as recall_at_1, round(avg(case when r <= 5 then 1.0 else 0.0 end), 6) as recall_at_5,
round(avg(case when r <= 10 then 1.0 else 0.0 end), 6) as recall_at_10, round(avg(coalesce(1 / r, 0)), 6) as mrr, round(avg(case when r <= 10 then 1 / log2(r + 1) else 0.0 end), 6) as ndcg_at_10"""


def _found(spark, d, rows, k):
    """The top k for the titles of rows."""
    terms = lexical.query_terms(rows.select(F.col("row_id").alias("query_id"), "title"), "query_id", X.analyze(F.col("title")))
    return named(spark, d, packed.search(packed_index(spark, d, X.analyze), terms, k))


def _ranks(spark, d):
    rows = table(spark, d, "products").where("row_id % 20 = 0 and title is not null")
    found = _found(spark, d, rows, 10)
    truth = rows.select(F.col("row_id").alias("query_id"), F.col("id").alias("doc_id"))
    return first_relevant_rank(found, truth, ["query_id"], "doc_id").join(rows.select(F.col("row_id").alias("query_id"), "category"), "query_id")


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 6) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")})


@query("recall_mrr_ndcg_E15_N1", f"{SELF} select {METRICS} from ranks")
def recall(spark, d):
    return _rounded(evaluate.rank_metrics(_ranks(spark, d)))


@query("metrics_by_type_E16_N2", f"{SELF} select category, {METRICS} from ranks group by grouping sets ((), (category))")
def by_type(spark, d):
    # Overall and by category in one pass: each case also counts under null.
    ranks = _ranks(spark, d).where("category is not null").withColumn("category", F.explode(F.array(F.col("category"), F.lit(None).cast("string"))))
    return _rounded(evaluate.rank_metrics(ranks, ["category"]))


@query("failures_N2", f"{SELF} select query_id, r as first_rank from ranks where r is null or r > 1")
def failures(spark, d):
    return _ranks(spark, d).where("first_rank is null or first_rank > 1").select("query_id", F.col("first_rank"))


@query(
    "hit_strict_loose_E25",
    f"""{SELF}, top as (select r.query_id, r.doc_id, d.category from ranked r join docs d using (doc_id) where rank <= 5)
select round(avg(case when exists (select 1 from top t where t.query_id = a.query_id and t.doc_id = a.id) then 1.0 else 0.0 end), 6) as strict,
  round(avg(case when exists (select 1 from top t where t.query_id = a.query_id and t.category = a.category) then 1.0 else 0.0 end), 6) as loose from asked a""",
)
def hit_strict_loose(spark, d):
    rows = table(spark, d, "products").where("row_id % 20 = 0 and title is not null")
    hit = _found(spark, d, rows, 5).join(table(spark, d, "products").select(F.col("id").alias("doc_id"), F.col("category").alias("hit_category")), "doc_id")
    per_query = rows.select(F.col("row_id").alias("query_id"), "id", "category").join(hit, "query_id", "left").groupBy("query_id")
    hits = per_query.agg(F.max(F.coalesce(F.col("doc_id") == F.col("id"), F.lit(False)).cast("double")).alias("s"), F.max(F.coalesce(F.col("hit_category") == F.col("category"), F.lit(False)).cast("double")).alias("l"))
    return hits.agg(F.round(F.avg("s"), 6).alias("strict"), F.round(F.avg("l"), 6).alias("loose"))


@query("first_relevant_F11", f"{SELF} select query_id, r as first_rank from ranks")
def first_relevant(spark, d):
    return _ranks(spark, d).select("query_id", "first_rank")


@query("localized_pick_B15_B16", "select id, case when coalesce(title, '') <> '' then title when row_id % 3 <> 0 and coalesce(category, '') <> '' then category else '' end as picked, case when row_id % 5 = 0 then (case when coalesce(source, '') <> '' then source else '' end) else concat_ws(' ', case when row_id % 3 <> 0 then nullif(category, '') end, nullif(title, '')) end as joined from products")
def localized(spark, d):
    entry = lambda tag, value: F.struct(F.lit(tag).alias("language_tag"), value.alias("value"))
    values = F.array(entry("en_US", F.when(F.col("row_id") % 3 != 0, F.col("category"))), entry("zh_CN", F.col("title")))
    # Where no value is in one of the languages, the join falls back to what the pick takes.
    others = F.when(F.col("row_id") % 5 == 0, F.array(entry("de_DE", F.col("source")))).otherwise(values)
    languages = ["zh_CN", "en_US"]
    return table(spark, d, "products").select("id", X.localized_pick(values, languages).alias("picked"), X.localized_join(others, languages).alias("joined"))


@query("resumable_scores_Q10", "select doc_id, n_chars from documents where doc_id not in (select doc_id from documents where doc_id % 4 = 0)")
def resumable(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return evaluate.unscored(rows, rows.where("doc_id % 4 = 0"), "doc_id")


@query("best_run_Q13", "select event_type, first(event_id order by value desc nulls last, event_id) as best from events group by event_type")
def best_run(spark, d):
    return evaluate.best_run(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id").select("event_type", F.col("event_id").alias("best"))


@query("top_by_category_F12", "select category, id, rank from (select category, id, row_number() over (partition by category order by price desc nulls last, row_id) as rank, 1 + length(category) % 4 as k from products where category is not null) where rank <= k")
def top_by_category(spark, d):
    rows = table(spark, d, "products").where("category is not null").select("category", "id", "price", "row_id", (1 + F.length("category") % 4).alias("k"))
    return top_k(rows, ["category"], [F.desc_nulls_last("price"), F.asc("row_id")], F.col("k")).select("category", "id", "rank")
