"""Queries of joins, aggregates, sets and rankings over the catalog and its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import dataset, evaluate, planner, ranking, sessions, synthetic
from quillstone.plans.registry import query
from quillstone.plans.text import BUDGET
from quillstone.session import table

LATEST = "last as (select product_id, stock, observed_at from inventory where product_id is not null and observed_at is not null qualify row_number() over (partition by product_id order by observed_at desc, recorded_at desc nulls last, stock desc nulls last) = 1)"


def _latest(spark, d):
    return dataset.latest_readings(table(spark, d, "inventory"), "product_id", "observed_at", "recorded_at")


@query("inventory_latest_A15", f"with {LATEST} select product_id, stock from last")
def inventory_latest(spark, d):
    return _latest(spark, d).select("product_id", "stock")


@query("inventory_join_J10_C6", f"with {LATEST} select p.id, l.stock as observed_stock, case when l.product_id is null then null else l.stock > 0 end as available from products p left join last l on l.product_id = p.id")
def inventory_join(spark, d):
    seen = _latest(spark, d).select("product_id", F.col("stock").alias("observed_stock"))
    joined = table(spark, d, "products").join(seen, F.col("id") == F.col("product_id"), "left")
    return joined.select("id", "observed_stock", (F.col("observed_stock") > 0).alias("available"))


@query("inventory_fresh_C7", f"with {LATEST}, now as (select max(observed_at) as t from last) select product_id, epoch(t) - epoch(observed_at) <= 30 * 86400 as fresh from last, now")
def inventory_fresh(spark, d):
    rows = _latest(spark, d)
    now = rows.agg(F.max("observed_at").alias("t"))
    age = F.unix_micros("t") - F.unix_micros("observed_at")
    return rows.crossJoin(F.broadcast(now)).select("product_id", (age <= 30 * 86400 * 1_000_000).alias("fresh"))


@query("inventory_unknown_G7", "select distinct product_id from inventory where product_id is not null except select id from products")
def inventory_unknown(spark, d):
    return table(spark, d, "inventory").select("product_id").where("product_id is not null").distinct().join(table(spark, d, "products").select(F.col("id").alias("product_id")), "product_id", "left_anti")


@query("compare_products_J11", "with r as (select a.doc_id as request_id, [a.product_id, b.product_id] as ids from documents a join documents b on b.doc_id = a.doc_id + 1), e as (select request_id, unnest(ids) as id, generate_subscripts(ids, 1) as pos from r) select request_id, pos::bigint as pos, p.id, p.title, p.price from e join products p using (id)")
def compare_products(spark, d):
    rows = table(spark, d, "documents")
    following = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("product_id").alias("other"))
    asked = rows.join(following, "doc_id").select(F.col("doc_id").alias("request_id"), F.posexplode(F.array("product_id", "other")).alias("pos", "id"))
    return asked.join(table(spark, d, "products"), "id").select("request_id", (F.col("pos") + 1).cast("long").alias("pos"), "id", "title", "price")


@query("best_by_rating_price_E29", "select category, first(id order by rating desc, price, row_id) as best from products where rating is not null and price is not null and category is not null group by category")
def best_by_rating(spark, d):
    rows = table(spark, d, "products").where("rating is not null and price is not null and category is not null")
    return rows.groupBy("category").agg(F.max_by("id", F.struct("rating", -F.col("price"), -F.col("row_id"))).alias("best"))


@query("category_counts_E27", "select category, count(*) as products, count(distinct source) as sources, round(sum(round(price * 100)) / count(price) / 100, 6) as mean_price, round(quantile_cont(price, 0.5), 4) as median_price from products group by category")
def category_counts(spark, d):
    return table(spark, d, "products").groupBy("category").agg(F.count(F.lit(1)).alias("products"), F.countDistinct("source").alias("sources"), F.round(F.sum(F.round(F.col("price") * 100)) / F.count("price") / 100, 6).alias("mean_price"), F.round(F.percentile("price", 0.5), 4).alias("median_price"))


SPLIT = "(case when lower(trim(split)) in ('val', 'valid', 'dev', 'validation') then 'validation' else lower(trim(split)) end)"
IMAGE = r"nullif(regexp_replace(lower(trim(image_sha256)), '^sha256:\s*', ''), '')"


@query("dataset_summary_E13", f"select count(*) as products, count(distinct {IMAGE}) as images, count({IMAGE}) - count(distinct {IMAGE}) as repeated_images, count(*) filter ({SPLIT} = 'train') as train, count(*) filter ({SPLIT} = 'validation') as validation, count(*) filter ({SPLIT} = 'test') as test from products")
def dataset_summary(spark, d):
    return dataset.summary(table(spark, d, "products"), "id", "image_sha256", "split")


@query("dedupe_content_G8", "select doc_id, min(doc_id) over (partition by coalesce(sha256(text), 'row' || doc_id)) as canonical, count(*) over (partition by coalesce(sha256(text), 'row' || doc_id)) as copies from documents")
def dedupe_content(spark, d):
    return dataset.canonical_content(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "canonical", "copies")


@query(
    "violations_C8",
    r"""select id, 'no source' as problem from products where coalesce(trim(source), '') = '' union all select id, 'no license' from products where coalesce(trim(license), '') = ''
union all select id, 'negative price' from products where price < 0 union all select id, 'negative stock' from products where stock < 0 union all select id, 'no id' from products where id is null
union all select id, 'repeated id' from products where id is not null group by id having count(*) > 1""",
)
def violations(spark, d):
    return dataset.violations(table(spark, d, "products"))


@query("interleave_category_F14", "select id, turn, row_number() over (order by turn, category nulls first) as place from (select id, category, row_number() over (partition by category order by row_id) as turn from products)")
def interleave(spark, d):
    return ranking.interleave(table(spark, d, "products").select("id", "category", "row_id"), "category", [F.asc("row_id")]).select("id", "turn", "place")


@query("seeded_sample_F15", "select id, title from products order by md5('7|' || id), id limit 100")
def seeded_sample(spark, d):
    return ranking.hashed_sample(table(spark, d, "products").select("id", "title"), "id", 100, 7)


@query("equispaced_F18", "with n as (select max(row_id) as m from products) select distinct id, row_id from products, n where row_id in (select cast(floor(i * m / 19.0) as bigint) from generate_series(0, 19) t(i), n)")
def equispaced(spark, d):
    rows = table(spark, d, "products").select("id", "row_id")
    steps = rows.agg(F.max("row_id").alias("m")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.floor(i * F.col("m") / 19.0))).alias("row_id")).distinct()
    return rows.join(F.broadcast(steps), "row_id").select("id", "row_id")


@query("disjoint_G9", f"select {IMAGE} as image from products where {SPLIT} = 'train' and {IMAGE} is not null intersect select {IMAGE} from products where {SPLIT} = 'test'")
def disjoint(spark, d):
    """The pictures that stand in the way of train and test being disjoint."""
    rows = table(spark, d, "products").withColumn("image", X.plain_hash(F.col("image_sha256"))).where("image is not null")
    return dataset.disjoint(dataset.of_split(rows, "train"), dataset.of_split(rows, "test"), "image")


@query("recent_documents_F16", "select product_id, doc_id from documents where product_id is not null qualify row_number() over (partition by product_id order by ingested_at desc nulls last, doc_id desc) <= 5")
def recent_documents(spark, d):
    rows = table(spark, d, "documents").where("product_id is not null").select("product_id", "doc_id", "ingested_at")
    return ranking.top_k(rows, ["product_id"], [F.desc_nulls_last("ingested_at"), F.desc("doc_id")], 5).select("product_id", "doc_id")


@query("latency_percentiles_E19_E20", "select event_type, count(*) as calls, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, round(quantile_cont(value, 0.95), 6) as p95_linear, round(avg(value), 6) as mean, max(value) as max from events group by event_type")
def latency_percentiles(spark, d):
    return evaluate.latency_summary(table(spark, d, "events"), ["event_type"], "value").withColumns({"p95_linear": F.round("p95_linear", 6), "mean": F.round("mean", 6)})


@query(
    "tool_metrics_E22",
    "select event_type, count(*) as calls, count(*) filter (user_id % 7 = 0) as replayed, round(avg(value) filter (user_id % 7 <> 0), 6) as mean, quantile_disc(value, 0.95) filter (user_id % 7 <> 0) as p95, max(value) filter (user_id % 7 <> 0) as max from events group by event_type",
)
def tool_metrics(spark, d):
    rows = table(spark, d, "events")
    timed = evaluate.latency_summary(rows, ["event_type"], "value", F.col("user_id") % 7 != 0)
    replayed = rows.groupBy("event_type").agg(F.count_if(F.col("user_id") % 7 == 0).alias("replayed"))
    return timed.join(replayed, "event_type").select("event_type", "calls", "replayed", F.round("mean", 6).alias("mean"), "p95", "max")


# The resamples are random; where their limits must lie, about, isn't.
@query("bootstrap_ci_E21", "select round(avg(rating), 6) as mean, true as around, true as wide from products where rating is not null")
def bootstrap(spark, d):
    rows = table(spark, d, "products").where("rating is not null")
    found = evaluate.bootstrap(rows, "rating").crossJoin(rows.agg((2 * 1.96 * F.stddev("rating") / F.sqrt(F.count("rating"))).alias("normal")))
    return found.select(F.round("mean", 6).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("around"), F.col("high").__sub__(F.col("low")).between(0.85 * F.col("normal"), 1.15 * F.col("normal")).alias("wide"))


def _turns(spark, d):
    number = F.element_at(F.split("id", "-", 2), -1).cast("long")
    return table(spark, d, "planner_test").select(F.floor(number / 10).alias("session_id"), (number % 10).alias("turn"), F.col("query").alias("text"))


TURNS = f"turns as (select cast(split_part(id, '-', 2) as bigint) // 10 as session_id, cast(split_part(id, '-', 2) as bigint) % 10 as turn, {BUDGET} as budget, regexp_extract_all(query, '(?i)\\b([a-z][a-z0-9]*-\\d{{2,}})\\b', 1) as ids from planner_test)"


@query(
    "session_slots_L2_L9",
    f"with {TURNS} select session_id, turn, last_value(budget ignore nulls) over w as max_price, coalesce(len(list_distinct(flatten(list(ids) over w))), 0)::int as n_ids from turns window w as (partition by session_id order by turn rows between unbounded preceding and current row)",
)
def session_slots(spark, d):
    return sessions.slots(_turns(spark, d))


FOLD = r"""turns as (select (cast(split_part(id, '-', 2) as bigint) // 10)::varchar as session_id, cast(split_part(id, '-', 2) as bigint) % 10 as turn, coalesce(regexp_extract_all(query, '(?i)\b([a-z][a-z0-9]*-\d{2,})\b', 1), []) as ids from planner_test),
named as (select session_id, id, min(turn * 1000 + i) as place from (select session_id, turn, unnest(ids) as id, generate_subscripts(ids, 1) as i from turns) group by all),
seen as (select session_id, string_agg(id, ',' order by place) as seen from named group by session_id)
select t.session_id, count(*) as turns, coalesce(any_value(s.seen), '') as seen from turns t left join seen s using (session_id) group by t.session_id"""


@query("session_fold_L2", f"with {FOLD}")
def session_fold(spark, d):
    return sessions.fold_sessions(_turns(spark, d)).select("session_id", "turns", F.array_join("seen", ",").alias("seen"))


@query("context_window_L3")
def context_window(spark, d):
    return sessions.context_windows(_turns(spark, d), 64)


@query(
    "constraint_guard_C10",
    "select a.doc_id as query_id, least(a.n_chars * 1.0, s.price) as max_value, coalesce(s.category, a.source) as category, least((a.doc_id % 9)::int, 3) as top_k, array_to_string(list_sort(list_distinct([a.product_id, s.id])), ',') as excluded from documents a left join products s on s.row_id = a.doc_id where a.product_id is not null",
)
def constraint_guard(spark, d):
    rows = table(spark, d, "documents").where("product_id is not null")
    asked = rows.select(F.col("doc_id").alias("query_id"), F.col("n_chars").cast("double").alias("max_value"), F.col("source").alias("category"), (F.col("doc_id") % 9).cast("int").alias("top_k"), F.array("product_id").alias("excluded"))
    state = table(spark, d, "products").select(F.col("row_id").alias("query_id"), F.col("price").alias("max_value"), "category", F.lit(5).alias("top_k"), F.array("id").alias("excluded"))
    return planner.tightened(asked, state).withColumn("excluded", F.array_join(F.sort_array("excluded"), ","))


@query("citations_K9", "select doc_id, case when doc_id % 5 = 0 then '' else coalesce(product_id, '') end as cited from documents")
def citations(spark, d):
    rows = table(spark, d, "documents")
    answers = rows.select("doc_id", F.concat(F.lit("推荐 ["), F.coalesce("product_id", F.lit("none")), F.lit("]")).alias("answer"), F.array_compact(F.array("product_id", F.lit("no-0000"))).alias("seen"), F.when(F.col("doc_id") % 5 == 0, F.array_compact(F.array("product_id"))).alias("excluded"))
    return planner.citations(answers).select("doc_id", F.array_join("citations", ",").alias("cited"))


@query("answer_text_B33", "select category, string_agg(title || ' [' || id || ']：评分 ' || printf('%.1f', rating), '；' order by rating desc, row_id) as answer from (select * from products where rating is not null and title is not null and category is not null qualify row_number() over (partition by category order by rating desc, row_id) <= 3) group by category")
def answer_text(spark, d):
    rows = table(spark, d, "products").where("rating is not null and title is not null and category is not null").select("category", "title", "id", "rating", "row_id")
    best = ranking.top_k(rows, ["category"], [F.desc("rating"), F.asc("row_id")], 3)
    line = F.format_string("%s [%s]：评分 %.1f", "title", "id", "rating")
    return best.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")).select("category", F.array_join(F.transform("lines", lambda x: x["line"]), "；").alias("answer"))


@query("anchor_mismatch_B34", r"with w as (select doc_id, list_distinct(regexp_extract_all(lower(lang || ' 12 kettle ' || coalesce(source, '')), '[a-z]{3,}|\d+')) as q, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}|\d+')) as t from documents), m as (select doc_id, [x for x in q if not list_contains(t, x)] as missing from w), held as (select distinct unnest(t) as x from w), hit as (select distinct doc_id from (select doc_id, unnest(missing) as x from m) join held using (x)) select m.doc_id, array_to_string(list_sort(missing), ',') as missing, h.doc_id is not null as foreign from m left join hit h on h.doc_id = m.doc_id")
def anchor_mismatch(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(" 12 kettle "), F.coalesce("source", F.lit(""))).alias("q"), "text")
    return dataset.anchor_mismatch(rows, "doc_id", "q", "text").withColumn("missing", F.array_join(F.sort_array("missing"), ","))


@query("events_windowed_L10", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def events_windowed(spark, d):
    from quillstone.streaming import feeds

    return feeds.windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 6))


@query("synthetic_catalog_O3", "select 10000 as rows, 10000 as ids, 10 as categories, true as priced, true as rated, true as stocked")
def synthetic_catalog(spark, d):
    """A log-normal price has the median exp(6) and 16 % of its mass above exp(6.8)."""
    made = synthetic.catalog(spark, 10_000)
    middle = F.percentile_approx("price", 0.5, 10_000).between(385.0, 423.0) & F.avg((F.col("price") > 897.85).cast("double")).between(0.145, 0.175)
    rated = (F.min("rating") >= 3.5) & (F.max("rating") <= 5) & F.avg("rating").between(4.23, 4.27)
    return made.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("product_id").alias("ids"), F.countDistinct("category").alias("categories"), middle.alias("priced"), rated.alias("rated"), ((F.min("stock") == 0) & (F.max("stock") == 199)).alias("stocked"))


@query("synthetic_vectors_O1", "select vec_id, vec_id % 16 as cluster, 1.0::double as norm from range(2000) t(vec_id)")
def synthetic_vectors(spark, d):
    return synthetic.vectors(spark, 2_000).select("vec_id", "cluster", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("versioned_save_L4", "select s.product_id, case when u.product_id is null then 1 else 2 end as version, coalesce(u.stock, s.stock) as stock from (select product_id, min(stock) as stock from inventory where product_id is not null group by product_id) s left join (select id as product_id, min(stock) as stock from products where row_id % 2 = 1 and stock is not null group by id) u using (product_id) union all select id, 1, min(stock) from products where row_id % 2 = 0 and stock is not null and id not in (select product_id from inventory where product_id is not null) group by id")
def versioned_save(spark, d):
    store = table(spark, d, "inventory").where("product_id is not null").groupBy("product_id").agg(F.min("stock").alias("stock")).select(F.col("product_id"), F.lit(1).alias("version"), "stock")
    updates = table(spark, d, "products").where("stock is not null").select(F.col("id").alias("product_id"), (F.col("row_id") % 2).cast("int").alias("read_version"), "stock")
    return sessions.versioned_save(store, updates, "product_id")
