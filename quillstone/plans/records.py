"""Queries over nested records, runs, sessions, and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import records as R
from quillstone.functions import text as X
from quillstone.operators import agents, dataset, evaluate, fusion, packed, ranking, segments, sessions, synthetic
from quillstone.operators.hybrid import Hybrid
from quillstone.plans.registry import query
from quillstone.plans.retrieval import ASKED, BASE, BM25, BOTH, asked, baseline_ranked, bm25, documents, named, packed_index, wanted
from quillstone.plans.text import SEARCHABLE, WIDE
from quillstone.plans.vectors import USABLE, usable
from quillstone.session import table
from quillstone.sources import catalog

TOKENS = f"(length(query) - length(regexp_replace(query, '{WIDE}', '', 'g')) + (length(regexp_replace(query, '{WIDE}', '', 'g')) + 3) // 4)"
NUMBER = "cast(split_part(id, '-', 2) as bigint)"


def _documents(spark, d):
    return table(spark, d, "documents")


@query("rendered_Q1", r"""select doc_id, coalesce(source, '') || coalesce(lang, '') as as_text, concat_ws(chr(10), lang, source) as lines,
  case when lang is not null and source not like '%"%' then '{"doc":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' else '' end as object from documents""")
def rendered(spark, d):
    fields = F.struct(F.col("source"), F.col("lang"), F.col("doc_id").alias("doc"))
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("doc", T.LongType())])
    lines = F.array_compact(F.array("lang", "source"))
    return _documents(spark, d).select(
        "doc_id",
        R.rendered(F.concat(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), T.StringType()).alias("as_text"),
        R.rendered(lines, T.ArrayType(T.StringType())).alias("lines"),
        F.when(F.col("lang").isNotNull() & ~F.contains("source", F.lit('"')), R.rendered(fields, kind)).otherwise("").alias("object"),
    )


_HITS = "transform(array(product_id, null, 'x-1', product_id), (p, i) -> named_struct('product', named_struct('id', if(i = 0, p, null), 'title', source, 'category', lang, 'price', double(n_chars), 'rating', 4.0D, 'stock', 1), 'product_id', if(i = 3, p, ''), 'id', if(i = 2, p, null), 'score', double(i), 'reasons', array('r')))"


@query("payload_ids_Q2", "select doc_id, case when product_id is null then 'x-1' else product_id || (case when product_id = 'x-1' then '' else ',x-1' end) end as ids from documents")
def payload_ids(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(R.payload_ids(F.expr(_HITS)), ",").alias("ids"))


@query("flat_candidates_Q4", "select doc_id, product_id, source as title, lang as category, n_chars::double as price, 0.0::double as score from documents where coalesce(product_id, '') <> ''")
def flat_candidates(spark, d):
    rows = _documents(spark, d).select("doc_id", F.explode(R.candidates(F.expr(_HITS))).alias("c"))
    return rows.select("doc_id", "c.product_id", "c.title", "c.category", "c.price", "c.score")


@query("public_trace_Q18", "select doc_id, coalesce(source, '') || ':' || (n_chars > 200) as shown from documents")
def public_trace(spark, d):
    trace = F.array(F.struct(F.coalesce("source", F.lit("")).alias("tool"), (F.col("n_chars") > 200).alias("ok"), F.col("text").alias("arguments")))
    return _documents(spark, d).select("doc_id", F.array_join(F.transform(R.public_trace(trace), lambda t: F.concat(t["tool"], F.lit(":"), t["ok"].cast("string"))), ",").alias("shown"))


@query("session_key_B30", """select doc_id, case when lang = 'demo' then source else 'auth:v1:' || sha256('["' || lang || '", "' || source || '"]') end as key from documents where source not like '%"%' and source not like '%\\%'""")
def session_key(spark, d):
    rows = _documents(spark, d).where(~F.contains("source", F.lit('"')) & ~F.contains("source", F.lit("\\")))
    return rows.select("doc_id", R.session_key(F.col("lang"), F.col("source")).alias("key"))


@query("hit_reasons_B28", "select id, array_to_string([x for x in ['商品文本与需求匹配', case when rating > 4 then '商品图片视觉特征相似' end, '价格不超过 ¥' || stock] if x is not null], '|') as reasons from products where stock is not null")
def hit_reasons(spark, d):
    rows = table(spark, d, "products").where("stock is not null")
    return rows.select("id", F.array_join(R.reasons(F.lit(1.0), F.when(F.col("rating") > 4, 1.0).otherwise(0.0), F.col("stock").cast("double")), "|").alias("reasons"))


@query("parsed_queries_Q12", "select row_id, case when row_id % 3 = 0 then null else 'q' || row_id || ',p' || row_id end as queries from products")
def parsed_queries(spark, d):
    # A third of the answers lacks an index; all hold items that aren't objects, or are of no use.
    answer = F.format_string('{"queries": [1, {"index": %d, "query": " p%d "}, {"index": 0, "query": "old"}, {"index": 0, "query": "q%d"}, {"index": 7, "query": "x"}, {"index": 1, "query": " "}, "y"]}', F.when(F.col("row_id") % 3 == 0, 5).otherwise(1), F.col("row_id"), F.col("row_id"))
    return table(spark, d, "products").select("row_id", F.array_join(R.parsed_queries(answer, F.lit(2)), ",").alias("queries"))


@query("compare_rows_Q19", "select a.row_id, f.field, case f.field when 'price' then a.price when 'rating' then a.rating else a.stock end::double as first, case f.field when 'price' then b.price when 'rating' then b.rating else b.stock end::double as second from products a join products b on b.row_id = a.row_id + 1 cross join (values ('price'), ('rating'), ('stock')) f(field)")
def compare_rows(spark, d):
    rows = table(spark, d, "products").select("row_id", "price", "rating", F.col("stock").cast("double").alias("stock"))
    other = rows.select((F.col("row_id") - 1).alias("row_id"), *(F.col(c).alias(f"other_{c}") for c in ("price", "rating", "stock")))
    both = rows.join(other, "row_id")
    return both.select("row_id", F.expr("stack(3, 'price', price, other_price, 'rating', rating, other_rating, 'stock', stock, other_stock) as (field, first, second)"))


_RUNS = """runs as (select doc_id, case when doc_id % 3 = 0 then [product_id] else [] end as relevant, [product_id, 'x-1'] as returned, case when doc_id % 5 = 0 then ['x-1'] else [] end as cited, case when doc_id % 7 = 0 then [product_id] else [] end as wanted,
  n_chars, source, lang from documents where product_id is not null)"""


@query(
    "run_metrics_E18_N4",
    f"""with {_RUNS} select count(*) as cases, count(*) filter (len(relevant) > 0) as retrieval_cases, case when count(*) filter (len(relevant) > 0) > 0 then 1.0::double end as retrieval,
  avg((coalesce(source, '') = 'review')::int) as tool, avg((n_chars <= 300)::int) as "constraint", avg((len(wanted) = 0 or doc_id % 2 = 0)::int) as task, 2.0::double as calls, round(count(*) filter (lang is null or lang <> 'en') / (2.0 * count(*)), 9) as invalid_calls,
  count(*) filter (len(cited) > 0) as citation_cases, round((count(*) filter (len(cited) > 0 and doc_id % 2 = 0)) / (count(*) filter (len(cited) > 0)), 9) as citation from runs""",
)
def run_metrics(spark, d):
    when = lambda n, value: F.when(F.col("doc_id") % n == 0, F.array(value)).otherwise(F.array().cast("array<string>"))
    even = F.col("doc_id") % 2 == 0
    runs = _documents(spark, d).where("product_id is not null").select(
        when(3, F.col("product_id")).alias("relevant_ids"),
        F.array("product_id", F.lit("x-1")).alias("returned_ids"),
        F.when(even, when(7, F.col("product_id"))).otherwise(when(7, F.lit("none"))).alias("expected_ids"),
        F.when(even, F.array(F.lit("x-1"))).otherwise(F.array(F.lit("y-2"))).alias("citations"),
        when(5, F.lit("x-1")).alias("expected_citations"),
        F.array(F.struct(F.when(F.col("source") == "review", "review").otherwise("other").alias("tool"), F.lit(None).cast("string").alias("error")), F.struct(F.lit("en").alias("tool"), F.when(F.coalesce("lang", F.lit("")) != "en", "invalid_arguments").alias("error"))).alias("trace"),
        F.lit("review").alias("expected_tool"),
        F.lit("fine").alias("answer"),
        F.array(F.lit("fin")).alias("expected_fragments"),
        F.lit(300.0).alias("max_price"),
        F.col("n_chars").cast("double").alias("highest_price"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )
    found = agents.run_metrics(runs, ["en", "review", "other"])
    return found.select("cases", "retrieval_cases", "retrieval", "tool", "constraint", "task", "calls", F.round("invalid_calls", 9).alias("invalid_calls"), "citation_cases", F.round("citation", 9).alias("citation"))


@query("load_summary_Q14", "select event_type, count(*) as calls, quantile_disc(value, 0.95) as p95, count(*) filter (user_id % 7 = 0) as errors, round(count(*) / (max(epoch(ts) + value / 1000) - min(epoch(ts))), 9) as rps from events group by event_type")
def load_summary(spark, d):
    calls = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return evaluate.load_summary(calls, ["event_type"], "value", F.col("user_id") % 7 == 0, "at").select("event_type", "calls", "p95", "errors", F.round("rps", 9).alias("rps"))


@query("alignment_Q16", "select problem, n from (select 'product without a vector' as problem, count(*) as n from products where id is not null and id not in (select product_id from vectors where product_id is not null) union all select 'vector without a product', count(*) from vectors where product_id is null or product_id not in (select id from products where id is not null) union all select 'vector of another dimension', count(*) from vectors where vectors is null or len(vectors) <> (select len(vectors) from vectors where vectors is not null group by 1 order by count(*) desc, 1 desc limit 1) union all select 'query of an unknown product', count(*) from documents where product_id is null or product_id not in (select id from products where id is not null) union all select 'query without a text', count(*) from documents where coalesce(text, '') = '') where n > 0")
def alignment(spark, d):
    vectors = table(spark, d, "vectors").select(F.col("product_id").alias("id"), F.col("vectors").alias("vector"))
    most = F.array_repeat(F.lit(0.0).cast("float"), 64)
    queries = _documents(spark, d).select("product_id", F.col("text").alias("query"), most.alias("vector"))
    return dataset.alignment(table(spark, d, "products"), vectors, queries).where("problem <> 'query of another dimension'")


@query("resolvable_images_Q15", "select count(*) as rows, count(image_path) as named, count(*) filter (image_path in (select image_path from products where row_id % 2 = 0)) as resolvable from products")
def resolvable_images(spark, d):
    rows = table(spark, d, "products")
    return dataset.resolvable_images(rows, rows.where("row_id % 2 = 0").select(F.col("image_path").alias("path")))


@query("split_filter_C9", "select id from products where lower(trim(split)) = 'test'")
def split_filter(spark, d):
    return dataset.of_split(table(spark, d, "products"), "test").select("id")


@query("concatenated_G3", "select 'products' as part, id from products union all select 'queries', id from planner_test")
def concatenated(spark, d):
    parts = {"products": table(spark, d, "products"), "queries": table(spark, d, "planner_test")}
    return dataset.combine([rows.select(F.lit(name).alias("part"), "id") for name, rows in parts.items()])


@query("encoding_statistics_E28", "select (select count(*) from planner_test) as items, count(*) as distinct_texts, count(*) filter (held) as cached, ceil(count(*) filter (not held) / 64)::bigint as batches from (select query, bool_or(cast(split_part(id, '-', 2) as bigint) % 2 = 0) as held from planner_test where query is not null group by query)")
def encoding_statistics(spark, d):
    items = table(spark, d, "planner_test").select(F.col("id").alias("key"), F.col("query").alias("text"))
    cache = items.where(F.element_at(F.split("key", "-", 2), -1).cast("long") % 2 == 0).where("text is not null").select(F.sha2("text", 256).alias("content")).distinct()
    return catalog.encoding_statistics(items, cache).select("items", "distinct_texts", "cached", "batches")


@query("hash_vectors_B32", "select id, true as unit, true as stable from planner_test")
def hash_vectors(spark, d):
    rows = table(spark, d, "planner_test").select("id", synthetic.hash_vectors(F.col("query")).alias("a"), synthetic.hash_vectors(F.concat(F.coalesce("query", F.lit("")), F.lit(""))).alias("b"))
    norm = F.aggregate("a", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("id", (F.abs(norm - 1) < 1e-5).alias("unit"), (F.col("a") == F.col("b")).alias("stable"))


@query("window_statistics_Q6_Q5", f"select ({NUMBER} // 10)::varchar as session_id, sum({TOKENS})::bigint as original_tokens, sum({TOKENS}) > 64 as compressed, false as over from planner_test where query is not null group by 1")
def window_statistics(spark, d):
    rows = table(spark, d, "planner_test").where("query is not null")
    number = F.element_at(F.split("id", "-", 2), -1).cast("long")
    turns = rows.select(F.floor(number / 10).alias("session_id"), (number % 10).alias("turn"), F.col("query").alias("text"))
    told = sessions.window_statistics(sessions.context_windows(turns, 64, keep=1000), 64)
    return told.select("session_id", "original_tokens", (F.col("compressed") | (F.col("original_tokens") > 64)).alias("compressed"), "over")


@query("over_budget_Q5", f"select id, {TOKENS} + 12 > 20 as over from planner_test where query is not null")
def over_budget(spark, d):
    rows = table(spark, d, "planner_test").where("query is not null")
    return rows.select("id", sessions.over_budget(F.lit("x" * 48), F.col("query"), 20).alias("over"))


@query("exact_truth_O2", "select 10 as k, 250 as pairs, true as own_cluster")
def exact_truth(spark, d):
    corpus = synthetic.vectors(spark, 500, 32, 16, 0.3)
    truth = synthetic.corpus_truth(corpus, corpus.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"))
    same = (F.col("query_id") % 16 == F.col("vec_id") % 16).cast("double")
    return truth.agg(F.max("rank").alias("k"), F.count(F.lit(1)).alias("pairs"), (F.avg(same) > 0.95).alias("own_cluster"))


_H2 = f"""{USABLE}, {BASE.replace('baseranked as', 'unused as').replace(' join docs using (doc_id))', ' join (select id as doc_id, row_id from products) using (doc_id))')},
pics as (select product_id, arg_min(v, vec_id) as v from vec where dimension = 64 and product_id is not null group by product_id),
q as (select a.query_id, a.query_id % 3 <> 0 as has_text, v.v is not null as has_image, v.v, case when a.query_id % 2 = 0 then 500.0 end as max_value from asked a left join vec v on v.vec_id = a.query_id and v.dimension = 64 and a.query_id % 40 = 0),
img as (select q.query_id, p.product_id as doc_id, greatest(0, round(list_cosine_similarity(q.v, p.v), 4)) as i from q join pics p on q.has_image),
sc as (select q.query_id, p.id as doc_id, p.row_id, p.rating, q.has_text, q.has_image, coalesce(b.score, 0) as t, coalesce(m.i, 0) as i, b.score is not null or m.i is not null as found
  from q cross join products p left join base b on b.query_id = q.query_id and b.doc_id = p.id left join img m on m.query_id = q.query_id and m.doc_id = p.id where q.max_value is null or p.price <= q.max_value),
fin as (select query_id, doc_id, row_id, rating, case when has_text or has_image then ((case when has_text then 65 * round(t * 10000)::bigint else 0 end) + (case when has_image then (case when has_text then 35 else 100 end) * round(i * 10000)::bigint else 0 end) + 50) // 100 / 10000.0 else round(rating / 5, 4) end::double as score from sc where found or not (has_text or has_image))"""


@query("hybrid_search_H2", f"with {ASKED}, {_H2} select query_id, row_number() over (partition by query_id order by score desc, rating desc nulls last, row_id) as rank, doc_id, score from fin qualify rank <= 10")
def hybrid_search(spark, d):
    vectors = usable(spark, d).where("dimension = 64")
    pictures = vectors.where("product_id is not null").groupBy("product_id").agg(F.min_by("v", "vec_id").alias("v"))
    queries = asked(spark, d).join(vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id", "left")
    queries = queries.select("query_id", (F.col("query_id") % 3 != 0).alias("has_text"), "qv", F.when(F.col("query_id") % 2 == 0, 500.0).alias("max_value"), F.lit("").alias("category"), F.lit(None).cast("array<string>").alias("excluded"))
    found = Hybrid.build(documents(spark, d), X.tokenize, pictures.select(F.col("product_id").alias("doc_id"), "v")).search(queries, wanted(spark, d, X.tokenize), 10)
    return found.select("query_id", "rank", "doc_id", "score")


@query("partition_sweep_N8", f"{BM25} select n.n as segments, count(*) as hits, true as same from ranked cross join (values (4), (16), (64)) n(n) where rank <= 10 and exists (select 1 from products p where p.id = doc_id and p.price is not null) and query_id in (select query_id from asked) group by n.n")
def partition_sweep(spark, d):
    """Whether a search over all segments gives what one over the whole catalog does, for plans of 4, 16 and 64 segments."""
    products = table(spark, d, "products").where("price is not null")
    whole = packed_index(spark, d, X.analyze)
    terms = wanted(spark, d, X.analyze)
    parts = []
    for n in (4, 16, 64):
        placed = segments.by_value(products, "price", n).select(F.col("id").alias("doc_id"), "segment")
        index = packed.PackedIndex.build(documents(spark, d).join(placed, "doc_id"), F.col("row_id"), X.analyze(F.col("text")), F.col("value"), F.col("category"), F.col("segment"))
        routes = placed.select(F.col("segment").cast("string").alias("segment")).distinct().join(asked(spark, d).select("query_id"), F.lit(True))
        ours = packed.search(packed.PackedIndex(index.blocks, whole.terms, whole.stats), terms, 10, routes=routes)
        flat = packed.search(whole, terms, 10)
        kept = flat.join(products.select(F.col("row_id").alias("number")), "number", "left_semi")
        both = kept.select("query_id", "number").join(ours.select("query_id", "number", F.lit(1).alias("found")), ["query_id", "number"], "left")
        parts.append(both.agg(F.lit(n).alias("segments"), F.count(F.lit(1)).alias("hits"), (F.count("found") == F.count(F.lit(1))).alias("same")))
    return dataset.combine(parts)


@query("hybrid_comparison_N7", f"{BOTH}, truth as (select query_id, doc_id from ranked where rank = 1), runs as (select 'bm25' as route, query_id, doc_id, rank from ranked union all select 'baseline', query_id, doc_id, rank from baseranked), hit as (select r.route, t.query_id, min(rank) filter (r.rank <= 10 and r.doc_id = t.doc_id) as r from truth t join runs r using (query_id) group by all) select route, count(*) as cases, round(avg(case when r is not null then 1.0 else 0.0 end), 6) as hit_at_10, round(avg(coalesce(1.0 / r, 0)), 6) as mrr from hit group by route")
def hybrid_comparison(spark, d):
    routes = {"bm25": bm25(spark, d, 10), "baseline": baseline_ranked(spark, d, 10)}
    truth = routes["bm25"].where("rank = 1").select("query_id", "doc_id")
    parts = []
    for name, found in routes.items():
        ranks = ranking.first_relevant_rank(found, truth, ["query_id"], "doc_id")
        parts.append(evaluate.rank_metrics(ranks).select(F.lit(name).alias("route"), "cases", F.round("recall_at_10", 6).alias("hit_at_10"), F.round("mrr", 6).alias("mrr")))
    return dataset.combine(parts)


@query(
    "rerank_model_H22",
    rf"""{BM25}, coarse as (select r.query_id, r.doc_id, r.rank, list_distinct([x for x in regexp_split_to_array(lower(a.query), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+') if x <> '']) as w,
  list_distinct(regexp_split_to_array({SEARCHABLE.replace('title', 'p.title').replace('category', 'p.category').replace('description', 'p.description').replace('attributes', 'p.attributes')}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+')) as t from ranked r join asked a using (query_id) join products p on p.id = r.doc_id where r.rank <= 30),
scored as (select *, round(len(list_intersect(w, t)) / len(w), 4) as score from coarse)
select query_id, row_number() over (partition by query_id order by score desc, rank) as place, doc_id, score from scored qualify place <= 10""".replace("as place", "as rank_").replace("qualify place <= 10", "qualify rank_ <= 10"),
)
def rerank_model(spark, d):
    coarse = bm25(spark, d, 30).join(asked(spark, d), "query_id").join(documents(spark, d).select("doc_id", "text"), "doc_id")
    return fusion.rerank_by_model(coarse, "query", "text", fusion.overlap_scorer, 10).withColumnRenamed("rank", "rank_")
