"""Vector and inverted indexes: build, save, load, filters, escalation, routes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ann, dense, lexical, packed


def vectors(spark, x, **columns):
    data = {"id": pa.array(np.arange(len(x))), "v": pa.array(list(x)), **{k: pa.array(v) for k, v in columns.items()}}
    return spark.createDataFrame(pa.table(data)).repartition(3)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    return np.repeat(rng.standard_normal((40, 16)), 25, axis=0) + 0.3 * rng.standard_normal((1000, 16))


def exact(x, asked, k, allowed=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        score = np.round(unit @ unit[i], 4)
        score[i] = -9
        if allowed is not None:
            score[~allowed(i)] = -9
        out[i] = [int(j) for j in np.argsort(-score, kind="stable")[:k] if score[j] > -9]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_all_lists_are_exact(spark, points, kind):
    data = vectors(spark, points)
    index = ann.AnnIndex.build(data, kind, lists=12)
    assert found(index.search(data.where("id % 50 = 0"), 7, probes=12)) == exact(points, range(0, 1000, 50), 7)
    assert index.list_sizes().sum() == 1000 and index.describe().first()["bytes_per_vector"] == 16 * 8 + 16


def test_saved_indexes(spark, points, tmp_path):
    data = vectors(spark, points)
    for kind in ("ivf", "ivfpq"):
        at = str(tmp_path / kind)
        built = ann.AnnIndex.build(data, kind, lists=8, bits=4)
        built.save(at)
        loaded = ann.AnnIndex.load(spark, at, kind, 16, 1000)
        how = {"vectors": data} if kind == "ivfpq" else {}
        assert found(loaded.search(data.where("id < 9"), 5, 3, **how)) == found(built.search(data.where("id < 9"), 5, 3, **how))
    for wrong in ({"kind": "ivf"}, {"dimension": 17}, {"count": 999}):
        with pytest.raises(ValueError, match="the index has"):
            ann.AnnIndex.load(spark, at, **wrong)
    built.blocks.limit(1).write.mode("overwrite").parquet(f"{at}/blocks")
    with pytest.raises(ValueError, match="manifest says 1000"):
        ann.AnnIndex.load(spark, at)


def test_what_an_index_refuses(spark, points):
    data = vectors(spark, points)
    with pytest.raises(ValueError, match="one dimension"):
        ann.AnnIndex.build(data.unionByName(vectors(spark, points[:3, :5])))
    with pytest.raises(ValueError, match="need 9984 vectors"):
        ann.AnnIndex.build(data, "ivfpq", bits=8)
    with pytest.raises(ValueError, match="kind"):
        ann.AnnIndex.build(data, "tree")
    with pytest.raises(ValueError, match="reranks"):
        ann.AnnIndex.build(data, "ivfpq", bits=3).search(data, 3)


def test_product_quantised_lists(spark, points):
    data = vectors(spark, points)
    index = ann.AnnIndex.build(data, "ivfpq", lists=16, bits=4)
    truth, got = exact(points, range(0, 1000, 20), 10), found(index.search(data.where("id % 20 = 0"), 10, 4, candidates=100, vectors=data))
    assert sum(len(set(truth[i]) & set(got[i])) for i in truth) >= 0.9 * sum(map(len, truth.values()))


def test_short_queries_probe_on(spark, points):
    value = np.arange(1000) * 37 % 1000
    data = vectors(spark, points, value=value.astype(float))
    asked = data.where("id % 40 = 0").select("id", "v", F.when(F.col("id") % 80 == 0, 900.0).otherwise(15.0).alias("most"))
    index = ann.AnnIndex.build(data, "ivf", value=F.col("value"), lists=20)
    fits = lambda i: value <= (900 if i % 80 == 0 else 15)
    truth = exact(points, range(0, 1000, 40), 10, fits)
    hits, stats = ann.filtered_search(index, asked, 10, F.col("most"), data, probes=2, rounds=6, grow=2)
    told = {r["query_id"]: r for r in stats.collect()}
    got = found(hits)
    assert len(told) == 25 and all(len(got[i]) == len(truth[i]) == 10 for i in truth)
    assert all(r["fallback"] == "none" and not r["exhausted"] and r["matched"] == 10 for r in told.values())
    assert max(r["rounds"] for r in told.values()) > 1 and all(r["probes"] == min(20, 2 ** r["rounds"]) for r in told.values())
    assert all(0 < r["examined"] <= 1000 for r in told.values())
    hits, stats = ann.filtered_search(index, asked, 10, F.col("most"), data, probes=1, rounds=1)
    told = {r["query_id"]: r["fallback"] for r in stats.collect()}
    got = found(hits)
    assert set(told.values()) == {"exact", "none"} and all(got[i] == truth[i] for i in truth if told[i] == "exact")
    hits, stats = ann.filtered_search(index, asked.withColumn("most", F.lit(2.0)), 10, F.col("most"), data)
    assert all(r["exhausted"] and r["matched"] == 3 - (value[r["query_id"]] <= 2) for r in stats.collect())


def test_many_queries_meet_by_a_join(spark, points, monkeypatch):
    data = vectors(spark, points)
    few = found(ann.AnnIndex.build(data, "ivf", lists=12).search(data.where("id % 50 = 0"), 7, probes=12))
    hashed = found(dense.lsh_search(data, data.where("id % 50 = 0"), 7))
    monkeypatch.setattr(ann, "SENT", 1)
    monkeypatch.setattr(dense, "SENT", 1)
    assert found(ann.AnnIndex.build(data, "ivf", lists=12).search(data.where("id % 50 = 0"), 7, probes=12)) == few
    assert found(dense.lsh_search(data, data.where("id % 50 = 0"), 7)) == hashed


def test_a_union_keeps_the_best_score(spark, rows):
    data = [[(1, 5, 0.3), (1, 6, 0.2)], [(1, 5, 0.7)], [(2, 5, 0.1)]]
    made = [spark.createDataFrame(d, "query_id long, vec_id long, score double") for d in data]
    assert rows(ann.union_best(made)) == [(1, 5, 0.7), (1, 6, 0.2), (2, 5, 0.1)]


@pytest.mark.parametrize("sent", [1000, 1 << 26])
def test_exact_search_in_parts_and_dimensions(spark, points, sent):
    mixed = vectors(spark, points).unionByName(vectors(spark, points[:30, :6]).withColumn("id", F.col("id") + 5000))
    got = found(dense.exact_search(mixed, mixed.where("id % 100 = 0 or id = 5003"), 4, "cosine", sent=sent))
    truth = exact(points, range(0, 1000, 100), 4)
    small = {5000 + i: [5000 + j for j in v] for i, v in exact(points[:30, :6], (0, 3), 4).items()}
    assert got == truth | {5000: small[5000], 5003: small[5003]}


def test_empty_tables(spark, points):
    data = vectors(spark, points[:5])
    none = data.limit(0)
    assert dense.exact_search(data, none).count() == 0 == dense.exact_search(none, data).count()
    assert ann.AnnIndex.build(none, "ivf").search(data, 3).count() == 0
    assert dense.lsh_search(none, data).count() == 0


DOCS = [(1, "red lamp lamp", 5.0, "Home"), (2, "red kettle", 9.0, "home"), (3, "blue lamp", None, "Garden"), (4, "", 1.0, None), (5, None, 2.0, "home"), (None, "red", 1.0, "home"), (7, "red lamp lamp", 4.0, "home")]


def inverted(spark, segment=None):
    docs = spark.createDataFrame(DOCS, "n long, t string, p double, c string").repartition(2)
    return packed.PackedIndex.build(docs, F.col("n"), F.split("t", " "), F.col("p"), F.col("c"), segment)


def asked(spark, *terms):
    return lexical.query_terms(spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "query_id long, t string"), "query_id", F.split("t", " "))


def test_packed_scores_equal_those_of_tables(spark, rows):
    docs = spark.createDataFrame([d for d in DOCS if d[0] is not None], "n long, t string, p double, c string")
    whole = lexical.build_index(docs.select("n", F.coalesce("t", F.lit(None)).alias("t")), "n", F.coalesce(F.split("t", " "), F.array().cast("array<string>")))
    terms = asked(spark, "red lamp", "lamp lamp blue", "none")
    want = rows(lexical.bm25_scores(whole, terms).select("query_id", "doc_id", F.round("score", 4)))
    assert rows(packed.search(inverted(spark), terms, 10).select("query_id", "number", "score")) == want
    assert [r["number"] for r in packed.search(inverted(spark), terms, 1).where("query_id = 0").collect()] == [1]  # a tie goes to the lower number


def test_packed_filters_come_before_the_cut(spark):
    limits = spark.createDataFrame([(0, 6.0, "HOME", [1]), (1, None, None, None)], "query_id long, max_value double, category string, excluded array<long>")
    got = packed.search(inverted(spark), asked(spark, "red lamp", "red lamp"), 2, limits=limits)
    assert [(r["query_id"], r["number"]) for r in got.orderBy("query_id", "rank").collect()] == [(0, 7), (1, 1), (1, 7)]


def test_packed_segments_and_folders(spark, tmp_path):
    segment = F.when(F.col("n") < 3, "low").otherwise("high")
    at = str(tmp_path / "index")
    inverted(spark, segment).save(at)
    index = packed.PackedIndex.load(spark, at, 6)
    assert {p.name for p in (tmp_path / "index" / "blocks").glob("part=*")} == {"part=low", "part=high"}
    routes = spark.createDataFrame([(0, "high")], "query_id long, segment string")
    got = packed.search(index, asked(spark, "lamp", "lamp"), 5, routes=routes)
    assert [(r["query_id"], r["number"]) for r in got.orderBy("rank").collect()] == [(0, 7), (0, 3)]
    assert packed.search(index, asked(spark, "lamp"), 5, routes=routes.limit(0)).count() == 0
    with pytest.raises(ValueError, match="6 documents"):
        packed.PackedIndex.load(spark, at, 5)
    assert index.describe().first()["documents"] == 6


def test_packed_overlap_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(packed, "ENTRIES", 1)
    got = packed.overlap_search(inverted(spark), asked(spark, "red lamp", "blue", "zzz"), 5)
    best = {r["query_id"]: (r["number"], r["score"]) for r in got.where("rank = 1").collect()}
    assert best == {0: (1, 1.0), 1: (3, 1.0)} and got.where("query_id = 0").count() == 4
    routes = spark.createDataFrame([(0, "high"), (1, "low")], "query_id long, segment string")
    routed = packed.search(inverted(spark, F.when(F.col("n") < 3, "low").otherwise("high")), asked(spark, "red lamp", "lamp", "blue"), 5, routes=routes)
    assert sorted((r["query_id"], r["number"]) for r in routed.collect()) == [(0, 3), (0, 7), (1, 1)]
    none = spark.createDataFrame(DOCS, "n long, t string, p double, c string").limit(0)
    assert packed.search(packed.PackedIndex.build(none, F.col("n"), F.split("t", " ")), asked(spark, "red"), 3).count() == 0
