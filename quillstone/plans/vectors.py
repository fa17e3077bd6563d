"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import ann, dense, evaluate
from quillstone.operators.ranking import top_k
from quillstone.plans.registry import query
from quillstone.session import cut, kept, scratch, table

USABLE = """vec as (select vec_id, product_id, dimension, vectors::double[] as v from vectors where vectors is not null and len(vectors) = dimension and dimension > 0
  and len([x for x in vectors if x is null or not isfinite(x)]) = 0 and len([x for x in vectors if x <> 0]) > 0)"""
PAIRED = "pairs as (select q.vec_id as query_id, r.vec_id, round(list_cosine_similarity(q.v, r.v), 4) as score, r.product_id from vec q join vec r on q.dimension = r.dimension and q.vec_id <> r.vec_id where q.vec_id % 20 = 0)"
RANKED = "ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from pairs)"
EMB = "select q.vec_id as query_id, r.vec_id, q.label as query_label, r.label, q.embedding::double[] as a, r.embedding::double[] as b from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0"


def usable(spark, d) -> DataFrame:
    """(vec_id, product_id, dimension, v): vectors that are there, of the stated length, finite and not all zeros."""
    v = F.col("vectors")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, d, "vectors").where(v.isNotNull() & (F.size(v) == F.col("dimension")) & (F.col("dimension") > 0) & finite & F.exists(v, lambda x: x != 0))
    return rows.select("vec_id", "product_id", "dimension", v.alias("v"))


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """All usable vectors, and those of the stated query set."""
    rows = usable(spark, d).select("vec_id", "v")
    return rows, rows.where("vec_id % 20 = 0")


def _embeddings(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows, rows.where("vec_id % 20 = 0")


@query("l2_normalise_B5", f"with {USABLE} select vec_id, round(sqrt(list_sum([x * x for x in v])), 4) as norm, round(v[1] / sqrt(list_sum([x * x for x in v])), 6) as first from vec")
def normalise(spark, d):
    return usable(spark, d).select("vec_id", F.round(V.norm(F.col("v")), 4).alias("norm"), F.round(V.l2_normalise(F.col("v"))[0], 6).alias("first"))


@query("cosine_pairs_B6", f"with {USABLE} select a.vec_id, round(list_cosine_similarity(a.v, b.v), 4) as cosine from vec a join vec b on b.vec_id = a.vec_id + 1 and a.dimension = b.dimension")
def cosine_pairs(spark, d):
    a, b = usable(spark, d), usable(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("dimension"), F.col("v").alias("w"))
    return a.join(b, ["vec_id", "dimension"]).select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 4).alias("cosine"))


@query("neg_l2_topk_B7", f"with p as ({EMB}) select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from (select query_id, vec_id, round(-list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 65)]), 4) as score from p) qualify rank <= 10")
def neg_l2(spark, d):
    rows, asked = _embeddings(spark, d)
    return dense.exact_search(rows, asked, 10, "l2")


@query(
    "blend_vectors_B9",
    f"""with {USABLE}, m as (select a.vec_id, case when b.v is null then a.v else [0.7 * a.v[i] + 0.3 * b.v[i] for i in range(1, len(a.v) + 1)] end as v
  from vec a left join vec b on b.vec_id = a.vec_id + 7 and a.dimension = b.dimension) select vec_id, round(v[1] / sqrt(list_sum([x * x for x in v])), 6) as first from m""",
)
def blend(spark, d):
    a, b = usable(spark, d), usable(spark, d).select((F.col("vec_id") - 7).alias("vec_id"), "dimension", F.col("v").alias("w"))
    return a.join(b, ["vec_id", "dimension"], "left").select("vec_id", F.round(V.blend(F.col("v"), F.col("w"), 0.3)[0], 6).alias("first"))


@query("dense_exact_topk_H5", f"with {USABLE}, {PAIRED}, {RANKED} select * from ranked where rank <= 10")
def dense_exact(spark, d):
    return dense.exact_search(*_vectors(spark, d), 10, "cosine")


@query(
    "exclude_then_topk_C3",
    f"with {USABLE}, {PAIRED}, {RANKED}, kept as (select query_id, vec_id, score from ranked where vec_id % 3 <> 0) select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from kept qualify rank <= 5",
)
def exclude_then_topk(spark, d):
    rows, asked = _vectors(spark, d)
    return dense.exact_search(rows.where("vec_id % 3 <> 0"), asked, 5, "cosine")


@query(
    "dense_filtered_topk_C5",
    f"with {USABLE}, {PAIRED} select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from (select p.* from pairs p join products c on c.id = p.product_id where c.price <= 400) qualify rank <= 5",
)
def dense_filtered(spark, d):
    cheap = table(spark, d, "products").where("price <= 400").select(F.col("id").alias("product_id"))
    fits = usable(spark, d).join(cheap, "product_id", "left_semi").select("vec_id", "v")
    return dense.exact_search(fits, _vectors(spark, d)[1], 5, "cosine")


@query(
    "knn_label_vote",
    f"""with p as ({EMB}), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select query_id, vec_id, query_label, label, round(list_inner_product(a, b), 4) as score from p)),
votes as (select query_id, query_label, label, count(*) as n from r where rank <= 10 group by all)
select query_id, query_label, label as voted, n as votes from votes qualify row_number() over (partition by query_id order by n desc, label) = 1""",
)
def knn_vote(spark, d):
    rows, asked = _embeddings(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = dense.exact_search(rows, asked, 10).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "label"))).where("r = 1")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return best.join(own, "query_id").select("query_id", "query_label", F.col("label").alias("voted"), "votes")


@query(
    "rerank_exact_H21",
    f"""with {USABLE}, pairs as (select q.vec_id as query_id, r.vec_id, round(-list_sum([(q.v[i] - r.v[i]) * (q.v[i] - r.v[i]) for i in range(1, len(q.v) + 1)]), 4) as coarse, round(list_cosine_similarity(q.v, r.v), 4) as score
  from vec q join vec r on q.dimension = r.dimension and q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
near as (select * from pairs qualify row_number() over (partition by query_id order by coarse desc, vec_id) <= 40)
select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from near qualify rank <= 10""",
)
def rerank_exact(spark, d):
    rows, asked = _vectors(spark, d)
    return dense.rerank_exact(dense.exact_search(rows, asked, 40, "l2"), rows, asked, 10)


def _index(spark, d, kind: str, recall: float, **how) -> tuple[ann.AnnIndex, int]:
    """An index of the embeddings and how many lists to probe; built once for a session and state of the table."""
    rows, asked = _embeddings(spark, d)

    def build():
        index = ann.AnnIndex.build(rows, kind, **how)
        return index, ann.enough_probes(index, rows, asked, 10, recall)

    return kept(spark, f"{d}/embeddings.parquet", f"ann-{kind}", build)


@query("ivf_topk_H7")
def ivf(spark, d):
    index, probes = _index(spark, d, "ivf", 0.95)
    return index.search(_embeddings(spark, d)[1], 10, probes)


@query("ivfpq_rerank_H8")
def ivfpq(spark, d):
    rows, asked = _embeddings(spark, d)
    index, probes = _index(spark, d, "ivfpq", 0.98, segments=32)
    return index.search(asked, 10, probes, candidates=200, vectors=rows)


@query("lsh_topk_H9")
def lsh(spark, d):
    return dense.lsh_search(*_embeddings(spark, d), 10)


@query("ann_recall_H7_H8_H9_N5", "select kind, (select count(*) from embeddings where vec_id % 20 = 0) as queries, true as enough from (values ('ivf'), ('ivfpq'), ('lsh')) t(kind)")
def ann_recall(spark, d):
    """Whether each approximate search finds at least 0.9 of the exact top 10."""
    rows, asked = _embeddings(spark, d)
    truth = dense.exact_search(rows, asked, 10, "cosine").select("query_id", "vec_id")
    found = {"ivf": ivf(spark, d), "ivfpq": ivfpq(spark, d), "lsh": lsh(spark, d)}
    return evaluate.recall_of_kinds(truth, found, 0.9)


def _valued(spark, d):
    """Embeddings with a value to filter by, and queries with bounds on it, some of which hardly any row keeps."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") * 7919 % 1000).cast("double").alias("value"))
    asked = rows.where("vec_id % 20 = 0").select("vec_id", "embedding", F.element_at(F.array(F.lit(1000.0), F.lit(200.0), F.lit(10.0), F.lit(2.0)), (F.col("vec_id") / 20 % 4 + 1).cast("int")).alias("most"))
    return rows, asked


VALUED = """val as (select vec_id, embedding::double[] as v, vec_id * 7919 % 1000 as value from embeddings), asks as (select vec_id as query_id, v, [1000, 200, 10, 2][(vec_id // 20) % 4 + 1] as most from val where vec_id % 20 = 0),
fits as (select query_id, vec_id, most, round(list_cosine_similarity(a.v, b.v), 4) as score from asks a join val b on b.value <= a.most and b.vec_id <> a.query_id)"""


def _filtered(spark, d, **how):
    rows, asked = _valued(spark, d)
    index = ann.AnnIndex.build(rows, "ivf", value=F.col("value"))
    return ann.filtered_search(index, asked, 10, F.col("most"), rows, **how)


@query("probe_escalation_H11_H10", f"with {VALUED}, n as (select query_id, count(*) as n from fits group by query_id) select a.query_id, least(10, coalesce(n, 0)) as hits from asks a join n using (query_id)")
def probe_escalation(spark, d):
    hits, _ = _filtered(spark, d)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "exact_fallback_H12",
    f"with {VALUED} select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from fits where most <= 2 qualify rank <= 10",
)
def exact_fallback(spark, d):
    # One round of one list, so queries that few rows fit are searched exactly.
    hits, stats = _filtered(spark, d, probes=1, rounds=1)
    return hits.join(stats.where("fallback = 'exact'").join(_valued(spark, d)[1].where("most <= 2").select(F.col("vec_id").alias("query_id")), "query_id").select("query_id"), "query_id", "left_semi")


@query("search_stats_H13_Q8", f"with {VALUED}, n as (select a.query_id, count(f.vec_id) as n from asks a left join fits f using (query_id) group by all) select query_id, least(10, n) as matched, n < 10 as exhausted, 'none' as fallback from n")
def search_stats(spark, d):
    _, stats = _filtered(spark, d)
    return stats.select("query_id", "matched", "exhausted", "fallback")


@query("filter_pressure_N6_C4", f"with {VALUED} select most, true as enough, count(distinct query_id) as queries from fits group by most")
def filter_pressure(spark, d):
    """Whether the filtered search agrees with the exact one, for each bound of the filter."""
    rows, asked = _valued(spark, d)
    hits, _ = _filtered(spark, d, probes=16)
    truth = ann.ranked(ann._exact_filtered(ann.Manifest("flat", 64, 0, 1), rows, ann._asked(asked, F.col("most")), 10), 10)
    both = truth.join(hits.select("query_id", "vec_id", F.lit(1).alias("found")), ["query_id", "vec_id"], "left").join(asked.select(F.col("vec_id").alias("query_id"), F.col("most").cast("int").alias("most")), "query_id")
    return both.groupBy("most").agg((F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.countDistinct("query_id").alias("queries"))


@query("ann_index_round_trip_I2_I3_A9_Q7", "select 'ivf' as kind, 64 as dimension, count(*) as count, true as same, true as refused from embeddings")
def ann_round_trip(spark, d):
    rows, asked = _embeddings(spark, d)
    with scratch(spark) as at:
        built = ann.AnnIndex.build(rows, "ivf")
        built.save(at)
        loaded = ann.AnnIndex.load(spark, at, "ivf", 64)
        try:
            ann.AnnIndex.load(spark, at, "ivfpq")
            refused = False
        except ValueError:
            refused = True
        a, b = (index.search(asked, 10, 8) for index in (built, loaded))
        differ = cut(a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("same")))
        described = cut(loaded.describe())
    return described.crossJoin(differ).select("kind", "dimension", "count", "same", F.lit(refused).alias("refused"))


@query("multi_round_union_G2", f"with {VALUED}, r as (select query_id, vec_id, score from fits qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10), p as (select vec_id as query_id, v from val where vec_id % 20 = 0), l as (select query_id, b.vec_id, round(-list_sum([(p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) for i in range(1, 65)]), 4) as score from p join val b on b.vec_id <> query_id qualify row_number() over (partition by query_id order by score desc, b.vec_id) <= 10) select query_id, vec_id, max(score) as score from (select * from r union all select * from l) group by all")
def multi_round_union(spark, d):
    rows, asked = _valued(spark, d)
    near = ann.ranked(ann._exact_filtered(ann.Manifest("flat", 64, 0, 1), rows, ann._asked(asked, F.col("most")), 10), 10)
    far = dense.exact_search(rows.select("vec_id", "embedding"), asked.select("vec_id", "embedding"), 10, "l2")
    return ann.union_best([r.select("query_id", "vec_id", "score") for r in (near, far)])


SETS = f"with {USABLE}, {PAIRED}, {RANKED}, t as (select query_id, list(vec_id) as t from ranked where rank <= 10 group by all), g as (select query_id, list(vec_id) as g from ranked where rank <= 12 and rank % 3 <> 0 group by all)"


def _sets(spark, d):
    near = dense.exact_search(*_vectors(spark, d), 12, "cosine")
    return near.groupBy("query_id").agg(F.collect_list(F.when(F.col("rank") <= 10, F.col("vec_id"))).alias("t"), F.collect_list(F.when(F.col("rank") % 3 != 0, F.col("vec_id"))).alias("g"))


@query("set_recall_E23", f"{SETS} select round(avg(len(list_intersect(g, t)) / len(t)), 6) as recall from t join g using (query_id)")
def set_recall(spark, d):
    return evaluate.set_recall(_sets(spark, d), "g", "t").withColumn("recall", F.round("recall", 6))


@query(
    "jaccard_parity_E24",
    f"{SETS} select avg(case when len(list_intersect(g, t)) = len(t) and len(g) = len(t) then 1.0 else 0.0 end) as set_match, round(avg(len(list_intersect(g, t)) / len(list_distinct(list_concat(g, t)))), 6) as jaccard, sum(len(t) - len(list_intersect(g, t)))::bigint as missing from t join g using (query_id)",
)
def jaccard(spark, d):
    return evaluate.set_agreement(_sets(spark, d), "g", "t").withColumn("jaccard", F.round("jaccard", 6))


@query(
    "margin_E30",
    f"""with p as ({EMB}), s as (select query_id, round(list_inner_product(a, b), 4) as score, query_label = label as is_truth from p),
m as (select query_id, round(max(score) filter (is_truth) - max(score) filter (not is_truth), 4) as margin from s group by query_id) select query_id, margin, abs(margin) <= 0.05 as close from m""",
)
def margin(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    best = lambda among, name: dense.exact_search(rows, rows.where("vec_id % 20 = 0"), 1, among=among).select("query_id", F.col("score").alias(name))
    return evaluate.margins(best("same", "truth").join(best("other", "other"), "query_id", "full_outer"))
