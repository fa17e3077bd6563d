"""Queries of lexical retrieval, fusion, reranking and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import evaluate, fusion, lexical, packed, segments
from quillstone.operators.baseline import Baseline
from quillstone.operators.ranking import top_k
from quillstone.plans.registry import query
from quillstone.plans.text import SEARCHABLE, terms_sql, tokens_sql
from quillstone.session import fresh_folder, kept, table, written

# The stated query set: every row whose number is divisible by 20, against all rows.
ASKED = "asked as (select cast(split_part(id, '-', 2) as bigint) as query_id, query from planner_test where cast(split_part(id, '-', 2) as bigint) % 20 = 0)"
INDEX = f"""docs as (select id as doc_id, row_id, rating, price, category, title, {terms_sql(SEARCHABLE)} as terms from products),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from docs) group by all),
stats as (select count(*) as n, coalesce(nullif(avg(len(terms)), 0), 1) as avgdl from docs),
terms as (select term, count(*) as df, ln(1 + ((select n from stats) - count(*) + 0.5) / (count(*) + 0.5)) as idf from postings group by term)"""
WANTED = f"wanted as (select query_id, term, count(*) as qtf from (select query_id, unnest({terms_sql('query')}) as term from asked) group by all)"
SCORES = """scores as (select w.query_id, p.doc_id, round(sum(t.idf * w.qtf * p.tf * 2.5 / greatest(p.tf + 1.5 * (0.25 + 0.75 * len(d.terms) / s.avgdl), 1e-12)), 4) as score
  from wanted w join terms t using (term) join postings p using (term) join docs d on d.doc_id = p.doc_id cross join stats s group by w.query_id, p.doc_id)"""
RANKED = "ranked as (select query_id, row_number() over (partition by query_id order by score desc, row_id) as rank, doc_id, score from scores join docs using (doc_id))"
BM25 = f"with {ASKED}, {INDEX}, {WANTED}, {SCORES}, {RANKED}"
BASE = f"""tokens as (select doc_id, term, count(*) as tf from (select id as doc_id, unnest({tokens_sql(SEARCHABLE)}) as term from products) group by all),
asks as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens_sql('query')}) as term from asked) group by all),
idf as (select term, ln(((select count(*) from products) + 1) / (count(*) + 1)) + 1 as idf from tokens group by term),
rawbase as (select query_id, doc_id, sum(least(qtf, tf) * idf) / any_value(n) as s from asks join (select query_id, sum(qtf) as n from asks group by query_id) using (query_id)
  join idf using (term) join tokens using (term) group by query_id, doc_id),
base as (select query_id, doc_id, round(s / max(s) over (partition by query_id), 4) as score from rawbase),
baseranked as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, row_id) as rank from base join docs using (doc_id))"""
BOTH = f"{BM25}, {BASE}"


def asked(spark, d):
    """(query_id, query) of the stated query set."""
    number = F.element_at(F.split("id", "-", 2), -1).cast("long")
    return table(spark, d, "planner_test").select(number.alias("query_id"), "query").where("query_id % 20 = 0")


def documents(spark, d):
    return lexical.searchable(table(spark, d, "products"))


def index(spark, d):
    return lexical.build_index(documents(spark, d), "doc_id", X.analyze(F.col("text")), ["row_id", "rating", "category", "value"])


def packed_index(spark, d, terms) -> packed.PackedIndex:
    """The packed index of the products' terms (analyze or tokenize); built once for a session and state of the table."""

    def build():
        return packed.PackedIndex.build(documents(spark, d), F.col("row_id"), terms(F.col("text")), F.col("value"), F.col("category"))

    return kept(spark, f"{d}/products.parquet", f"packed-{terms.__name__}", build)


def named(spark, d, hits):
    """hits(query_id, rank, number, score) with the products' ids."""
    ids = table(spark, d, "products").select(F.col("row_id").alias("number"), F.col("id").alias("doc_id"))
    return ids.join(hits, "number").select("query_id", "rank", "doc_id", "score")


def wanted(spark, d, terms):
    return lexical.query_terms(asked(spark, d), "query_id", terms(F.col("query")))


def bm25(spark, d, k):
    return named(spark, d, packed.search(packed_index(spark, d, X.analyze), wanted(spark, d, X.analyze), k))


def baseline(spark, d) -> Baseline:
    """The baseline of the products' tokens; built once for a session and state of the table."""
    return kept(spark, f"{d}/products.parquet", "baseline", lambda: Baseline.build(documents(spark, d), X.tokenize))


def baseline_ranked(spark, d, k):
    return named(spark, d, packed.overlap_search(packed_index(spark, d, X.tokenize), wanted(spark, d, X.tokenize), k))


@query("term_freq_E1", f"with {INDEX} select doc_id, term, tf from postings")
def term_freq(spark, d):
    return index(spark, d).postings.select("doc_id", "term", "tf")


@query("doc_freq_idf_E2_B11", f"with {INDEX} select term, df, round(idf, 6) as idf from terms")
def doc_freq(spark, d):
    return index(spark, d).terms.withColumn("idf", F.round("idf", 6))


@query("doc_length_stats_E3", f"with {INDEX} select n, round(avgdl, 6) as avgdl from stats")
def doc_length(spark, d):
    return index(spark, d).stats.withColumn("avgdl", F.round("avgdl", 6))


@query("posting_sizes_E4", f"with {INDEX} select len(term) as term_length, count(*) as terms, sum(df)::bigint as postings from terms group by all")
def posting_sizes(spark, d):
    return index(spark, d).terms.groupBy(F.length("term").cast("long").alias("term_length")).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


@query("lexical_score_H1", f"with {ASKED}, {BASE.replace('baseranked as', 'unused as').replace(' join docs using (doc_id))', ' join (select id as doc_id, row_id from products) using (doc_id))')} select query_id, doc_id, score from base")
def lexical_score(spark, d):
    return baseline(spark, d).scores(wanted(spark, d, X.tokenize))


@query("bm25_topk_H3", f"{BM25} select query_id, rank, doc_id, score from ranked where rank <= 10")
def bm25_topk(spark, d):
    return bm25(spark, d, 10)


@query(
    "bm25_filtered_C1_C2_C3",
    f"""{BM25}, allowed as (select s.query_id, s.doc_id, s.score, d.row_id from scores s join docs d using (doc_id)
  where (s.query_id % 3 <> 0 or d.price <= 300 + s.query_id % 500) and (s.query_id % 2 <> 0 or contains(lower(d.category), '机')) and d.doc_id not in (select doc_id from ranked where rank = 1 and query_id = s.query_id))
select query_id, row_number() over (partition by query_id order by score desc, row_id) as rank, doc_id, score from allowed qualify rank <= 5""",
)
def bm25_filtered(spark, d):
    index, terms = packed_index(spark, d, X.analyze), wanted(spark, d, X.analyze)
    first = packed.search(index, terms, 1).select("query_id", F.array("number").alias("excluded"))
    limits = asked(spark, d).select("query_id", F.when(F.col("query_id") % 3 == 0, 300.0 + F.col("query_id") % 500).alias("max_value"), F.when(F.col("query_id") % 2 == 0, "机").otherwise("").alias("category"))
    return named(spark, d, packed.search(index, terms, 5, limits=limits.join(first, "query_id", "left")))


@query("rating_fallback_F9", "select id, score, rank from (select id, round(rating / 5, 4) as score, row_number() over (partition by category order by rating desc nulls last, row_id) as rank from products) where rank <= 20")
def rating_fallback(spark, d):
    rows = table(spark, d, "products").select("id", "category", "row_id", "rating", F.round(F.col("rating") / 5, 4).alias("score"))
    return top_k(rows, ["category"], [F.desc_nulls_last("rating"), F.asc("row_id")], 20).select("id", "score", "rank")


FUSED = "coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id"


@query(
    "score_fusion_H17",
    f"""{BOTH}, a as (select * from baseranked where rank <= 20), b as (select query_id, doc_id, rank, score / (select max(score) from scores) as score from ranked where rank <= 20)
select {FUSED}, round(0.65 * coalesce(a.score, 0) + 0.35 * coalesce(b.score, 0), 4) as score from a full join b on a.query_id = b.query_id and a.doc_id = b.doc_id""",
)
def score_fusion(spark, d):
    other = bm25(spark, d, 20)
    best = other.agg(F.max("score").alias("best"))
    other = other.crossJoin(F.broadcast(best)).withColumn("score", F.col("score") / F.col("best"))
    return fusion.score_fusion(baseline_ranked(spark, d, 20), other)


def _rrf_sql(k: int, weight: float) -> str:
    return f"""{BOTH}, routes as (select query_id, doc_id, rank, 0 as route, 1.0 as w from ranked where rank <= 50 union all select query_id, doc_id, rank, 1, {weight} from baseranked where rank <= 50),
fused as (select query_id, doc_id, sum(w / (60 + rank)) as s, min(route * 1000000 + rank) as seen, count(*) as routes from routes group by all)
select query_id, row_number() over (partition by query_id order by round(s, 12) desc, seen, doc_id) as rank, doc_id, round(s, 6) as score, routes from fused qualify rank <= {k}"""


@query("rrf_H18", _rrf_sql(10, 1.0))
def rrf(spark, d):
    return fusion.rrf([bm25(spark, d, 50), baseline_ranked(spark, d, 50)], 10)


@query("rrf_weighted_H18", _rrf_sql(10, 2.5))
def rrf_weighted(spark, d):
    return fusion.rrf([bm25(spark, d, 50), baseline_ranked(spark, d, 50)], 10, weights=[1.0, 2.5])


@query("rrf_route_stats_E8", f"{BOTH} select 0 as route, count(*) as hits, count(distinct query_id) as queries from ranked where rank <= 50 union all select 1, count(*), count(distinct query_id) from baseranked where rank <= 50")
def route_stats(spark, d):
    return fusion.route_statistics([bm25(spark, d, 50), baseline_ranked(spark, d, 50)])


@query(
    "rerank_score_table_J7",
    f"""{BOTH}, coarse as (select r.query_id, r.doc_id, r.rank, b.score as t from ranked r left join base b on b.query_id = r.query_id and b.doc_id = r.doc_id where r.rank <= 30)
select query_id, row_number() over (partition by query_id order by coalesce(t, '-inf'::double) desc, rank) as rank, doc_id, coalesce(t, '-inf'::double) as score from coarse qualify rank_ok(1)""".replace(" qualify rank_ok(1)", " qualify row_number() over (partition by query_id order by coalesce(t, '-inf'::double) desc, rank) <= 10"),
)
def rerank_table(spark, d):
    # Scores of the candidates alone, as shares of each query's best document in the whole catalog.
    coarse = written(bm25(spark, d, 30))
    return fusion.rerank_by_table(coarse, baseline(spark, d).scores_of(coarse, wanted(spark, d, X.tokenize)), 10)


@query(
    "candidate_window_E26",
    f"""{BOTH}, truth as (select query_id, doc_id from baseranked where rank <= 5), w as (select unnest([1, 5, 10, 25, 50]) as "window")
select "window", avg(case when r.rank <= "window" then 1.0 else 0.0 end) as recall from truth t left join (select * from ranked where rank <= 50) r on r.query_id = t.query_id and r.doc_id = t.doc_id cross join w group by "window\"""",
)
def candidate_window(spark, d):
    return evaluate.window_sweep(bm25(spark, d, 50), baseline_ranked(spark, d, 5), [1, 5, 10, 25, 50])


@query("candidate_union_G1", f"{BOTH} select query_id, count(*) as candidates from (select query_id, doc_id from ranked where rank <= 20 union select query_id, doc_id from baseranked where rank <= 20) group by query_id")
def candidate_union(spark, d):
    both = bm25(spark, d, 20).select("query_id", "doc_id").union(baseline_ranked(spark, d, 20).select("query_id", "doc_id")).distinct()
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


PRICE_SEGMENTS = """edges as (select list_distinct([quantile_cont(price, i / 8.0) for i in range(0, 9)]) as e from products),
inner_edges as (select list_sort(e)[2:len(e) - 1] as e from edges),
seg as (select p.id, p.price, p.category, len([x for x in e if x <= p.price]) as segment from products p, inner_edges where p.price is not null)""".replace(
    "list_distinct([quantile_cont(price, i / 8.0) for i in range(0, 9)])", "list_distinct(quantile_cont(price, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))"
)
TWO_LEVEL = PRICE_SEGMENTS.replace("quantile_cont(price, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])", "quantile_cont(price, [0, 0.25, 0.5, 0.75, 1])").replace("as e from products)", "as e, lower(category) as c from products where price is not null group by lower(category))").replace("as e from edges", "as e, c from edges").replace("from products p, inner_edges where p.price is not null", "from products p join inner_edges on c = lower(p.category) where p.price is not null").replace("len([x for x in e if x <= p.price]) as segment", "c || '#' || len([x for x in e if x <= p.price]) as segment")


def _priced(spark, d):
    return segments.by_value(table(spark, d, "products").where("price is not null"), "price", 8)


@query("segment_plan_price_H15", f"with {PRICE_SEGMENTS} select id, segment from seg")
def segment_price(spark, d):
    return _priced(spark, d).select("id", F.col("segment").cast("long").alias("segment"))


@query("segment_plan_category_E11", "select lower(category) as segment, count(*) as size, min(price) as low, max(price) as high from products group by 1")
def segment_category(spark, d):
    return segments.statistics(segments.by_category(table(spark, d, "products"), "category"), "price", "category").drop("categories")


@query("segment_plan_two_level_E12", f"with {TWO_LEVEL} select id, segment from seg")
def segment_two_level(spark, d):
    rows = table(spark, d, "products").where("price is not null and category is not null")
    return segments.by_category_and_value(rows, "category", "price", 4).select("id", "segment")


@query("segment_stats_E9_E10", f"with {PRICE_SEGMENTS} select segment, count(*) as size, min(price) as low, max(price) as high, array_to_string(list_sort(list_distinct(list(lower(category)))), ',') as categories from seg group by segment")
def segment_stats(spark, d):
    return segments.statistics(_priced(spark, d), "price", "category").select(F.col("segment").cast("long").alias("segment"), "size", "low", "high", F.array_join("categories", ",").alias("categories"))


LIMITS = "limits as (select query_id, 100.0 + query_id % 700 as max_value, case when query_id % 40 = 0 then '机' else '' end as category from asked)"


def _limits(spark, d):
    return asked(spark, d).select("query_id", (100.0 + F.col("query_id") % 700).alias("max_value"), F.when(F.col("query_id") % 40 == 0, "机").otherwise("").alias("category"))


@query(
    "segment_prune_C5_Q9",
    f"""with {ASKED}, {LIMITS}, {PRICE_SEGMENTS}, st as (select segment, count(*) as size, min(price) as low, list_distinct(list(lower(category))) as cs from seg group by segment)
select query_id, count(*) as segments, sum(size)::bigint as rows, round(sum(size) / (select sum(size) from st), 6) as share from limits q join st on low <= max_value and (q.category = '' or len([c for c in cs if contains(c, q.category)]) > 0) group by query_id""",
)
def segment_prune(spark, d):
    stats = segments.statistics(_priced(spark, d), "price", "category")
    return segments.scanned_share(stats, segments.surviving(stats, _limits(spark, d))).withColumn("share", F.round("share", 6))


@query(
    "segmented_search_equals_exact_H16",
    f"""{BM25}, {LIMITS}, fits as (select s.query_id, s.doc_id, s.score, d.row_id from scores s join docs d using (doc_id) join limits l using (query_id) where d.price <= l.max_value and (l.category = '' or contains(lower(d.category), l.category)))
select query_id, row_number() over (partition by query_id order by score desc, row_id) as rank, doc_id, score from fits qualify rank <= 10""",
)
def segmented_search(spark, d):
    def build():
        products = table(spark, d, "products").where("price is not null")
        placed = segments.by_value(products, "price", 8)
        rows = documents(spark, d).join(placed.select(F.col("id").alias("doc_id"), "segment"), "doc_id")
        index = packed.PackedIndex.build(rows, F.col("row_id"), X.analyze(F.col("text")), F.col("value"), F.col("category"), F.col("segment"))
        return index, written(segments.statistics(placed, "price", "category").withColumn("segment", F.col("segment").cast("string")))

    # A plan of segments and their statistics belong to the index; a query only chooses among them.
    built, stats = kept(spark, f"{d}/products.parquet", "segmented", build)
    # Statistics of terms are those of the whole catalog.
    whole = packed_index(spark, d, X.analyze)
    index = packed.PackedIndex(built.blocks, whole.terms, whole.stats)
    none = _limits(spark, d).withColumn("excluded", F.lit(None).cast("array<long>"))
    return named(spark, d, packed.search(index, wanted(spark, d, X.analyze), 10, limits=none, routes=segments.surviving(stats, _limits(spark, d))))


@query("segment_index_round_trip_I4_A8", f"{BM25}, {LIMITS}, fits as (select s.query_id, s.doc_id, s.score, d.row_id from scores s join docs d using (doc_id) join limits l using (query_id) where d.price <= l.max_value and (l.category = '' or contains(lower(d.category), l.category))) select query_id, row_number() over (partition by query_id order by score desc, row_id) as rank, doc_id, score from fits qualify rank <= 10")
def segment_round_trip(spark, d):
    """segmented_search() on an index that was saved, a folder for each segment, and loaded again."""
    products = table(spark, d, "products").where("price is not null")
    placed = segments.by_value(products, "price", 8)
    alive = segments.surviving(segments.statistics(placed, "price", "category"), _limits(spark, d)).withColumn("segment", F.col("segment").cast("string"))
    rows = documents(spark, d).join(placed.select(F.col("id").alias("doc_id"), "segment"), "doc_id")
    at = fresh_folder(spark, "index")
    packed.PackedIndex.build(rows, F.col("row_id"), X.analyze(F.col("text")), F.col("value"), F.col("category"), F.col("segment")).save(at)
    whole = packed_index(spark, d, X.analyze)
    index = packed.PackedIndex(packed.PackedIndex.load(spark, at, products.count()).blocks, whole.terms, whole.stats)
    none = _limits(spark, d).withColumn("excluded", F.lit(None).cast("array<long>"))
    return named(spark, d, packed.search(index, wanted(spark, d, X.analyze), 10, limits=none, routes=alive))


@query("index_size_Q7", "select count(*) as documents, true as counted from products")
def index_size(spark, d):
    return packed_index(spark, d, X.analyze).describe().select("documents", ((F.col("bytes") > 0) & (F.col("terms") > 0) & (F.col("blocks") > 0)).alias("counted"))


@query("segment_partition_G6", "select count(*) as rows, count(distinct id) as keys, count(*) as covered, count(*) = count(distinct id) as complete from products where price is not null")
def segment_partition(spark, d):
    return segments.is_partition(_priced(spark, d), "id")
