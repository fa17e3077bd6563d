import inspect

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import ann, dense, evaluate, fusion, lexical, ranking, segments, synthetic
from quillstone.plans import QUERIES


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_terms_keep_models_and_bridge_han(spark):
    assert {"5w-30", "a19", "led", "灯", "灯泡"} <= set(one(spark, X.analyze(F.col("t")), t="LED灯泡 5W-30 A19"))
    assert one(spark, X.analyze(F.col("t")), t="灯") == ["灯"]
    assert "灯泡" in one(spark, X.analyze(F.col("t")), t="灯 A 泡")
    assert spark.sql("select cast(null as string) t").select(X.analyze(F.col("t"))).first()[0] == []


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("运动鞋", 3), ("abcd", 1), ("abcdefgh", 2), ("运动鞋abcd", 4)])
def test_token_estimates(spark, text, tokens):
    assert one(spark, X.estimate_tokens(F.col("t")), t=text) == tokens


def test_budget_and_ids(spark):
    assert one(spark, X.budget(F.col("t")), t="想找500元以内的运动鞋") == 500
    assert one(spark, X.budget(F.col("t")), t="预算不超过 89.5") == 89.5
    assert one(spark, X.product_ids(F.col("t")), t="shoe-001 和 bag-02 和 shoe-001") == ["shoe-001", "bag-02"]
    assert one(spark, X.excluded_ids(F.col("t")), t="不要 shoe-002") == ["shoe-002"]


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(texts)], "doc_id string, text string, row_id long")


def search(spark, texts, query, k=10):
    index = lexical.build_index(docs(spark, texts), "doc_id", X.analyze(F.col("text")), ["row_id"])
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    return [r["doc_id"] for r in lexical.bm25_search(index, queries, X.analyze(F.col("query")), k, "row_id").orderBy("rank").collect()]


def test_bm25_ranks_the_exact_model_first(spark):
    assert search(spark, ["5W-30 汽车机油 5升", "汽车机油 1夸脱", "厨房收纳盒"], "5W-30 机油")[0] == "d0"


def test_bm25_edge_cases(spark):
    assert search(spark, [None, ""], "灯") == []
    assert search(spark, ["灯泡", "机油"], "") == []
    assert search(spark, ["灯泡", "灯泡", "灯泡"], "灯泡", 2) == ["d0", "d1"]
    with pytest.raises(ValueError, match="k1"):
        lexical.bm25_scores(lexical.build_index(docs(spark, ["a"]), "doc_id", X.analyze(F.col("text"))), spark.createDataFrame([], "query_id long, term string, qtf long"), k1=-1)


def test_index_round_trip(spark, tmp_path, rows):
    index = lexical.build_index(docs(spark, ["红 灯泡", "机油"]), "doc_id", X.analyze(F.col("text")), ["row_id"])
    index.save(str(tmp_path))
    assert rows(lexical.Index.load(spark, str(tmp_path)).postings) == rows(index.postings)


def test_filters_come_before_the_cut(spark, rows):
    hits = spark.createDataFrame([(1, "a", 9.0), (1, "b", 8.0), (1, "c", 7.0)], "query_id long, doc_id string, score double")
    catalog = spark.createDataFrame([("a", 100.0, "运动鞋"), ("b", 10.0, "箱包"), ("c", 10.0, "跑步运动鞋")], "doc_id string, value double, category string")
    asked = spark.createDataFrame([(1, 50.0, "运动", ["x"])], "query_id long, max_value double, category string, excluded array<string>")
    assert rows(lexical.allowed(hits, asked, catalog).select("doc_id")) == [("c",)]


def routes(spark, *lists):
    return [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id string, rank int") for ids in lists]


def order(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    assert order(fusion.rrf(routes(spark, ["agreed", "a_tail"], ["b_head", "agreed"])))[0] == "agreed"
    assert order(fusion.rrf(routes(spark, ["big", "shared"], ["small", "shared"])))[:2] == ["shared", "big"]
    two = routes(spark, ["d1", "shared"], ["shared", "s1"])
    assert order(fusion.rrf(two))[0] == "shared"
    assert order(fusion.rrf(two, weights=[200.0, 1.0]))[0] == "d1"
    for bad in ({"rrf_k": 0}, {"weights": [1.0, 0.0]}):
        with pytest.raises(ValueError):
            fusion.rrf(two, **bad)
    with pytest.raises(ValueError):
        fusion.rrf([])


def test_score_fusion_and_rerank(spark, rows):
    score = lambda pairs: spark.createDataFrame([(1, d, s) for d, s in pairs], "query_id long, doc_id string, score double")
    fused = fusion.score_fusion(score([("exact", 1.0), ("other", 0.0)]), score([("exact", 0.1), ("other", 1.0)]), 0.7)
    assert rows(fused.select("doc_id", "score")) == [("exact", 0.73), ("other", 0.3)]
    coarse = routes(spark, ["a", "b", "c"])[0]
    table = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.9)], "query_id long, doc_id string, table_score double")
    assert order(fusion.rerank_by_table(coarse, table, 3)) == ["b", "c", "a"]
    texts = coarse.withColumns({"q": F.lit("red lamp"), "d": F.when(F.col("doc_id") == "c", "a red lamp").otherwise("kettle")})
    assert order(fusion.rerank_by_model(texts, "q", "d", fusion.overlap_scorer, 2)) == ["c", "a"]
    assert order(fusion.rerank_by_model(texts, "q", "d", lambda q, d: [1.0], 3)) == ["a", "b", "c"]


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 5, 64])
def test_exact_search_keeps_the_order_of_ids_at_the_cut(spark, metric, k):
    same = spark.range(40).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    got = dense.exact_search(same, same.where("id = 3"), k, metric).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(40) if i != 3][:k]


def test_approximate_search_against_exact(spark):
    data = synthetic.vectors(spark, 1200, dim=32, clusters=12, spread=0.6).select("vec_id", "vector").cache()
    asked = data.where("vec_id % 20 = 0")
    truth = {(r["query_id"], r["vec_id"]) for r in dense.exact_search(data, asked, 10).collect()}

    def recall(df):
        return len(truth & {(r["query_id"], r["vec_id"]) for r in df.collect()}) / len(truth)

    narrow, wide = (recall(ann.ivf_search(data, asked, 10, probes=p)) for p in (1, 8))
    assert narrow <= wide and wide > 0.95
    assert recall(ann.pq_search(data, asked, 10, bits=4, segments=8, candidates=200)) > 0.9
    assert recall(dense.lsh_search(data, asked, 10)) > 0.9
    with pytest.raises(ValueError, match="vectors"):
        ann.pq_search(data, asked, bits=8)


def test_inverted_lists_of_many_rows_are_probed_enough(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64)) * np.linspace(1, 0.5, 64) + 0.05
    data = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "v": pa.array(list(x))})).repartition(4)
    got = ann.ivf_search(data, data.where("id % 40 = 0"), 10).collect()
    unit, truth = dense.unit(x), set()
    for i in range(0, len(x), 40):
        score = np.round(unit @ unit[i], 4)
        score[i] = -9
        truth |= {(i, int(j)) for j in np.argsort(-score, kind="stable")[:10]}
    recall = len(truth & {(r["query_id"], r["vec_id"]) for r in got}) / len(truth)
    print(f"recall of inverted lists: {recall:.4f}")
    assert len(got) == len(truth) and recall > 0.9


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, V.l2_normalise(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.blend(F.col("a"), F.col("b"), 0.5), a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx([2**-0.5] * 2)
    assert spark.sql("select array(3d, 4d) a, cast(null as array<double>) b").select(V.query_vector(F.col("a"), F.col("b"))).first()[0] == [0.6, 0.8]


def test_segments_never_lose_a_match(spark):
    catalog = spark.range(120).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 60, "运动鞋").otherwise("箱包").alias("category"), F.when(F.col("id") < 60, 1000 + 10 * F.col("id")).otherwise(F.col("id")).cast("double").alias("price"))
    placed = segments.by_value(catalog, "price", 4)
    sizes = [r["size"] for r in segments.statistics(placed, "price", "category").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    stats = segments.statistics(placed, "price", "category")
    asked = spark.createDataFrame([(1, 999.99, ""), (2, 1000.0, "运动"), (3, 5.0, "鞋"), (4, None, None)], "query_id long, max_value double, category string")
    alive = {(r["query_id"], r["segment"]) for r in segments.surviving(stats, asked).collect()}
    fits = placed.crossJoin(asked.withColumnRenamed("category", "q")).where("(max_value is null or price <= max_value) and (coalesce(q, '') = '' or contains(category, q))")
    assert {(r["query_id"], r["segment"]) for r in fits.select("query_id", "segment").collect()} <= alive
    assert not [a for a in alive if a[0] == 3]
    assert segments.is_partition(placed, "id").first()["complete"]


def test_metrics(spark, rows):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "query_id long, first_rank int")
    got = evaluate.rank_metrics(ranks).first()
    assert (got["recall_at_1"], got["recall_at_5"], got["mrr"]) == (1 / 3, 2 / 3, pytest.approx(4 / 9))
    pairs = spark.createDataFrame([([1, 2, -1], [1, 3]), ([5], []), ([4], [4])], "got array<long>, truth array<long>")
    assert evaluate.set_recall(pairs, "got", "truth").first()["recall"] == 0.75
    assert evaluate.set_recall(pairs.limit(0), "got", "truth").first()["recall"] is None
    interval = evaluate.bootstrap(spark.createDataFrame([(1.0,)] * 30 + [(0.0,)] * 30, "v double"), "v", 200).first()
    assert interval["low"] < 0.5 < interval["high"] and interval["mean"] == 0.5


def test_bootstrap_query_draws_2000_resamples(spark, monkeypatch):
    drawn, bootstrap = [], evaluate.bootstrap

    def noted(values, value, resamples=inspect.signature(bootstrap).parameters["resamples"].default):
        drawn.append(resamples)
        return bootstrap(values, value, resamples)

    monkeypatch.setattr(evaluate, "bootstrap", noted)
    QUERIES["bootstrap_ci_E21"](spark, "/root/testdata/sf0.001")
    assert drawn == [2000]
    data = spark.range(4000).select((F.col("id") % 50).cast("double").alias("v"))
    got = bootstrap(data, "v").first()
    half = 1.96 * np.arange(50).std() / 4000**0.5
    assert got["mean"] == 24.5 and abs(24.5 - got["low"] - half) < 0.1 * half and abs(got["high"] - 24.5 - half) < 0.1 * half
    assert bootstrap(data.repartition(3), "v").first() == pytest.approx(got)


def test_ranking(spark, rows):
    data = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4), (None, 5)], "g string, i long")
    got = ranking.interleave(data, "g", [F.asc("i")]).orderBy("place").collect()
    assert [r["i"] for r in got] == [5, 1, 2, 3, 4]
    assert ranking.hashed_sample(data, "i", 3, 1).count() == 3
    assert rows(ranking.hashed_sample(data, "i", 3, 1)) == rows(ranking.hashed_sample(data.repartition(3), "i", 3, 1))


def test_synthetic_data_is_seeded(spark, rows):
    a, b = synthetic.catalog(spark, 50, 1), synthetic.catalog(spark, 50, 2)
    assert rows(a) == rows(synthetic.catalog(spark, 50, 1).repartition(3)) != rows(b)
    v = np.array([r["vector"] for r in synthetic.vectors(spark, 40, spread=0.0).orderBy("vec_id").collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5) and np.allclose(v[0], v[16], atol=1e-6)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None, 9.0, 2.5, 2.5, 2.5], [float(i * 37 % 101) for i in range(500)]])
def test_exact_quantiles(spark, values):
    fractions = [0, 0.125, 0.5, 0.9, 1]
    data = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    want = np.quantile([v for v in values if v is not None], fractions).tolist() if values else []
    assert ranking.exact_quantiles(data, "x", fractions).first()["quantiles"] == pytest.approx(want)
