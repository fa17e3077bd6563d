"""Queries of text expressions and rule-based plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import dataset, planner
from quillstone.plans.registry import query
from quillstone.session import table

ATTRIBUTES = "coalesce(array_to_string([concat_ws(' ', e.key, e.value) for e in map_entries(attributes)], ' '), '')"
SEARCHABLE = f"lower(concat_ws(' ', title, category, description, nullif({ATTRIBUTES}, '')))"
# The patterns of functions/text.py in SQL.
LATIN, HAN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", r"[\x{4e00}-\x{9fff}]"
WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def terms_sql(text: str) -> str:
    """SQL of X.analyze()."""
    chars = f"regexp_extract_all(lower({text}), '{HAN}')"
    return f"coalesce(list_concat(list_concat(regexp_extract_all(lower({text}), '{LATIN}'), {chars}), [({chars})[i] || ({chars})[i + 1] for i in range(1, len({chars}))]), [])"


def tokens_sql(text: str) -> str:
    """SQL of X.tokenize()."""
    return f"coalesce(regexp_extract_all(lower({text}), '{HAN}|[a-z0-9]+'), [])"


# The patterns and words of functions/text.py, which results depend on, in SQL.
BUDGET = r"""coalesce(nullif(regexp_extract(query, '(\d+(?:\.\d+)?)\s*元\s*(?:以内|以下|之内)', 1), ''),
  nullif(regexp_extract(query, '预算\s*(?:为|是|不超过|低于)?\s*(\d+(?:\.\d+)?)', 1), ''),
  nullif(regexp_extract(query, '(?:不超过|低于|小于)\s*(\d+(?:\.\d+)?)\s*元?', 1), ''))::double"""
INTENT = """case when requested_intent is not null and requested_intent <> 'auto' then requested_intent
  when query like '%对比%' or query like '%比较%' or query like '%区别%' then 'compare'
  when query like '%库存%' or query like '%有货%' or query like '%现货%' then 'inventory' else 'search' end"""
PLANS = f"""names as (select distinct category from products where category is not null and category <> ''),
matched as (select t.query as q, first(n.category order by length(n.category) desc, n.category) as category
  from (select distinct query from planner_test where query is not null) t join names n on contains(lower(t.query), lower(n.category)) group by t.query),
plans as (select p.id, {INTENT} as intent, {BUDGET} as max_price, m.category, p.expected, p.tags from planner_test p left join matched m on m.q = p.query)"""


def _documents(spark, d):
    return table(spark, d, "documents")


@query("tokenize_B1", f"select doc_id, array_to_string({tokens_sql('text')}, ' ') as tokens from documents")
def tokenize(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query("analyze_terms_B2", f"select id, array_to_string({terms_sql('title')}, ' ') as terms from products")
def analyze(spark, d):
    return table(spark, d, "products").select("id", F.array_join(X.analyze(F.col("title")), " ").alias("terms"))


@query("searchable_text_B3", f"select id, {SEARCHABLE} as text from products")
def searchable_text(spark, d):
    return table(spark, d, "products").select("id", X.searchable_text(*map(F.col, ("title", "category", "description", "attributes"))).alias("text"))


@query("product_document_B4", "select id, " + STRIP.format(f"coalesce(title, '') || '。' || coalesce(category, '') || '。' || concat_ws(' ', nullif(description, ''), nullif({ATTRIBUTES}, ''))") + " as text from products")
def product_document(spark, d):
    return table(spark, d, "products").select("id", X.product_document(*map(F.col, ("title", "category", "description", "attributes"))).alias("text"))


@query("html_strip_B17", "select id, substring(" + STRIP.format("regexp_replace('<p class=\"x\">' || description || '</p>', '<[^>]+>', ' ', 'g')") + ", 1, 4000) as text from products")
def html_strip(spark, d):
    marked = F.concat(F.lit('<p class="x">'), "description", F.lit("</p>"))
    return table(spark, d, "products").select("id", X.strip_html(marked).alias("text"))


@query("estimate_tokens_B21", f"select doc_id, coalesce(length(text) - length(regexp_replace(text, '{WIDE}', '', 'g')) + (length(regexp_replace(text, '{WIDE}', '', 'g')) + 3) // 4, 0)::bigint as tokens from documents")
def estimate_tokens(spark, d):
    return _documents(spark, d).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("stable_split_B19", "select id, case when b < 80 then 'train' when b < 90 then 'validation' when b is not null then 'test' end as split from (select id, ('0x' || substr(sha256(id), 1, 8))::bigint % 100 as b from products)")
def stable_split(spark, d):
    return table(spark, d, "products").select("id", X.stable_split(F.col("id")).alias("split"))


@query("content_hash_B20", "select doc_id, sha256(text) as hash from documents")
def content_hash(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("attribute_question_B35", "select id, case when len(v) > 0 then '想找一款' || array_to_string(v[1:3], '、') || '的' || category || '，请推荐符合这些属性的商品' end as question from (select id, category, [x for x in map_values(attributes) if x is not null and x <> ''] as v from products)")
def attribute_question(spark, d):
    return table(spark, d, "products").select("id", X.attribute_question(F.col("attributes"), F.col("category")).alias("question"))


@query("point_question_B36", "select id, '找一款 ' || id || ' 同款商品' as question from products")
def point_question(spark, d):
    return table(spark, d, "products").select("id", X.point_question(F.col("id")).alias("question"))


@query("product_ids_B25", r"select doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\b([a-z][a-z0-9]*-\d{2,})\b', 1))), ','), '') as ids from documents")
def product_ids(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(F.sort_array(X.product_ids(F.col("text"))), ",").alias("ids"))


@query("idempotency_key_B29", "select id, substr(sha256('search|{\"category\":\"' || category || '\",\"stock\":' || stock || '}'), 1, 32) as key from products where category is not null and stock is not null")
def idempotency_key(spark, d):
    rows = table(spark, d, "products").where("category is not null and stock is not null")
    return rows.select("id", X.idempotency_key(F.lit("search"), F.struct("category", "stock")).alias("key"))


@query("attribute_map_B18", "select id, e.key as key, e.value as value from (select id, unnest(map_entries(attributes)) as e from products) where e.value is not null and e.value <> ''")
def attribute_map(spark, d):
    return dataset.attribute_rows(table(spark, d, "products"))


@query("plan_queries_K1", f"with {PLANS} select id, intent, max_price, category from plans")
def plan_queries(spark, d):
    return planner.plan_queries(table(spark, d, "planner_test"), table(spark, d, "products"))


@query(
    "planner_accuracy_E17",
    f"""with {PLANS}, ok as (select tags, (intent is not distinct from expected.intent)::int as i, (max_price is not distinct from expected.max_price)::int as p,
  (category is not distinct from expected.category)::int as c from plans where expected is not null),
spread as (select unnest(list_concat([null], coalesce(list_distinct(tags), []))) as tag, i, p, c from ok)
select tag, count(*) as cases, avg(i) as intent, avg(p) as max_price, avg(c) as category, avg(i * p * c) as joint from spread group by tag""",
)
def planner_accuracy(spark, d):
    cases = table(spark, d, "planner_test")
    return planner.planner_accuracy(cases, planner.plan_queries(cases, table(spark, d, "products")))
