"""Nested records, run metrics, hybrid search, alignment, sessions and small helpers."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone import session
from quillstone.functions import records as R
from quillstone.functions import text as X
from quillstone.operators import agents, dataset, evaluate, fusion, lexical, sessions, synthetic
from quillstone.operators.hybrid import Hybrid
from quillstone.plans import QUERIES
from quillstone.sources import catalog
from quillstone.streaming import feeds


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rendering(spark):
    kind = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    made = F.struct(F.lit(2).cast("long").alias("b"), F.lit("ü").alias("a"))
    assert value(spark, R.rendered(made, kind)) == '{"a":"ü","b":2}'
    assert value(spark, R.rendered(F.array(made, made), T.ArrayType(kind))) == '{"a":"ü","b":2}\n{"a":"ü","b":2}'
    assert value(spark, R.rendered(F.lit(None).cast("string"), T.StringType())) == "" and value(spark, R.rendered(F.lit("x"), T.StringType())) == "x"
    entries = T.MapType(T.StringType(), T.LongType())
    assert value(spark, R.rendered(F.create_map(F.lit("z"), F.lit(1), F.lit("a"), F.lit(2)), entries)) == '{"a":2,"z":1}'
    assert value(spark, R.rendered(F.lit(None).cast("array<string>"), T.ArrayType(T.StringType()))) == ""


def test_ids_and_candidates(spark):
    item = "named_struct('product', named_struct('id', {0}, 'title', 't', 'category', 'c', 'price', 1.0D, 'rating', 2.0D, 'stock', 3), 'product_id', {1}, 'id', {2}, 'score', 0.5D, 'reasons', array('r'))"
    items = F.expr("array(" + ",".join(item.format(*x) for x in (("'a'", "'b'", "'c'"), ("''", "'b'", "'c'"), ("null", "null", "'c'"), ("'a'", "null", "null"), ("''", "''", "''"))) + ")")
    assert value(spark, R.payload_ids(items)) == ["a", "b", "c"]
    assert [c["product_id"] for c in value(spark, R.candidates(items, 3))] == ["a", "a"]
    assert value(spark, R.payload_ids(F.lit(None).cast("array<struct<product:struct<id:string>,product_id:string,id:string>>"))) == []


@pytest.mark.parametrize(("answer", "want"), [('{"queries": [{"index": 1, "query": "b"}, {"index": 0, "query": " a "}, 3]}', ["a", "b"]), ('{"queries": [{"index": 0, "query": "a"}]}', None), ("not json", None), (None, None), ('{"queries": 7}', None)])
def test_parsed_answers(spark, answer, want):
    assert value(spark, R.parsed_queries(F.lit(answer).cast("string"), F.lit(2))) == want


def test_keys_and_reasons(spark):
    key = lambda p, s: value(spark, R.session_key(F.lit(p).cast("string"), F.lit(s).cast("string")))
    assert key("demo", "s") == "s" and key(None, "s") is None
    import hashlib
    import json

    assert key('a"b', "ü") == "auth:v1:" + hashlib.sha256(json.dumps(['a"b', "ü"], ensure_ascii=False).encode()).hexdigest()
    why = lambda t, i, p: value(spark, R.reasons(F.lit(t), F.lit(i), F.lit(p).cast("double")))
    assert why(0.5, 0.0, None) == ["商品文本与需求匹配"] and why(0.0, 0.2, 99.5) == ["商品图片视觉特征相似", "价格不超过 ¥99.5"] and why(0.0, 0.0, 300.0) == ["价格不超过 ¥300"]


def test_run_metrics(spark):
    run = dict(relevant_ids=["a"], returned_ids=["a", "b"], expected_ids=[], citations=["b"], expected_citations=["b"], trace=[Row(tool="search", error=None)], expected_tool="search", answer="a lamp", expected_fragments=["lamp"], max_price=5.0, highest_price=4.0, latency_ms=10.0)
    runs = [run, run | dict(relevant_ids=["z"], expected_ids=["q"], citations=["x"], trace=[Row(tool="none", error=None), Row(tool="search", error="invalid_arguments")], highest_price=6.0, latency_ms=30.0), run | dict(relevant_ids=[], expected_citations=[], trace=[], expected_fragments=["kettle"], max_price=None)]
    schema = "relevant_ids array<string>, returned_ids array<string>, expected_ids array<string>, citations array<string>, expected_citations array<string>, trace array<struct<tool:string,error:string>>, expected_tool string, answer string, expected_fragments array<string>, max_price double, highest_price double, latency_ms double"
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in runs], schema)
    got = agents.run_metrics(table, ["search"]).first().asDict()
    assert got == dict(cases=3, retrieval_cases=2, retrieval=0.5, tool=pytest.approx(1 / 3), constraint=pytest.approx(2 / 3), task=pytest.approx(1 / 3), calls=1.0, invalid_calls=pytest.approx(2 / 3), citation_cases=2, citation=0.5, grounded=0.5, p50=10.0, p95=30.0)
    assert agents.run_metrics(table.limit(0), ["search"]).first()["cases"] == 0


def test_hybrid_search(spark):
    queries = spark.createDataFrame([(1, True, True, None, "", None), (2, True, False, None, "", None), (3, False, True, 10.0, "", None), (4, False, False, None, "home", ["c"])], "query_id long, has_text boolean, has_image boolean, max_value double, category string, excluded array<string>")
    docs = spark.createDataFrame([("a", 0, 4.0, 5.0, "Home"), ("b", 1, 5.0, 20.0, "garden"), ("c", 2, 4.5, 8.0, "home")], "doc_id string, row_id long, rating double, value double, category string")
    text = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "a", 1.0), (2, "c", 0.2)], "query_id long, doc_id string, score double")
    image = spark.createDataFrame([(1, "b", 0.9), (1, "c", -0.4), (3, "a", 0.3), (3, "b", 0.8), (3, "c", 0.3)], "query_id long, doc_id string, score double")
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in fusion.hybrid(queries, text, image, docs, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 0.65), (1, "b", 0.64), (1, "c", 0.0), (2, "a", 0.65), (2, "c", 0.13), (3, "c", 0.3), (3, "a", 0.3), (4, "a", 0.8)]


def test_alignment(spark, rows):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0]), ("x", [1.0]), ("y", None)], "id string, vector array<double>")
    queries = spark.createDataFrame([("a", "q", [1.0, 1.0]), ("z", "", [1.0])], "product_id string, query string, vector array<double>")
    assert dict(rows(dataset.alignment(ids, vectors, queries))) == {"vector without a product": 2, "vector of another dimension": 2, "query without a text": 1, "query of another dimension": 1, "query of an unknown product": 1}
    assert rows(dataset.alignment(ids, vectors.limit(2), queries.limit(1))) == []


def test_plain_splits_and_hashes(spark):
    split = lambda x: value(spark, X.plain_split(F.lit(x).cast("string")))
    assert [split(x) for x in (" Val ", "DEV", "test", "train\t", "other", None)] == ["validation", "validation", "test", "train", None, None]
    plain = lambda x: value(spark, X.plain_hash(F.lit(x).cast("string")))
    assert [plain(x) for x in (" SHA256: AB ", "ab", "", None)] == ["ab", "ab", None, None]


def test_windows_and_budgets(spark):
    windows = spark.createDataFrame([("a", 10, 40), ("b", 0, 0), ("c", 70, 60)], "session_id string, tokens long, original_tokens long")
    assert {r["session_id"]: (r["ratio"], r["compressed"], r["over"]) for r in sessions.window_statistics(windows, 64).collect()} == {"a": (0.25, True, False), "b": (1.0, False, False), "c": (1.1667, False, True)}
    assert value(spark, sessions.over_budget(F.lit("x" * 40), F.lit("灯" * 10), 20)) is False and value(spark, sessions.over_budget(F.lit("x" * 40), F.lit("灯" * 11), 20)) is True


def test_load_and_best_runs(spark):
    calls = spark.createDataFrame([(1, 0.0, 500.0, False), (1, 1.5, 500.0, True), (2, 0.0, 0.0, False)], "c int, at double, ms double, failed boolean")
    got = {r["c"]: (r["errors"], r["rps"]) for r in evaluate.load_summary(calls, ["c"], "ms", F.col("failed"), "at").collect()}
    assert got == {1: (1, 1.0), 2: (0, None)}
    runs = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 9.0), ("x", 3, 9.0), ("y", 1, None)], "g string, n int, rps double")
    assert sorted((r["g"], r["n"]) for r in evaluate.best_run(runs, ["g"], "rps", "n").collect()) == [("x", 2), ("y", 1)]


def test_hash_vectors_and_encoding_statistics(spark, tmp_path):
    a, b, none = (synthetic.hash_vector(t, 8) for t in ("lamp", "kettle", None))
    assert (a == synthetic.hash_vector("lamp", 8)).all() and not (a == b).any() and len(none) == 8
    items = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "key string, text string")
    cache = items.limit(1).select(F.sha2("text", 256).alias("content"))
    assert catalog.encoding_statistics(items, cache).first().asDict() == dict(items=4, distinct_texts=2, cached=1, hit_rate=0.5, batches=1, mean_batch=1.0)
    cases = spark.createDataFrame([("1", "t", "q", None, ["a"])], catalog.CASES)
    catalog.write_cases(cases, str(tmp_path / "cases"))
    assert catalog.read_jsonl(spark, str(tmp_path / "cases"), catalog.CASES).collect() == cases.collect()


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    batches = [[("a", "2024-01-01 00:10:00", 1.0)], [("a", "2024-01-01 09:00:00", 1.0)], [("a", "2024-01-01 00:20:00", 5.0), ("a", "2024-01-01 09:10:00", 2.0)], [("a", "2024-01-01 20:00:00", 1.0)]]
    source, at = str(tmp_path / "in"), str(tmp_path / "run")
    for batch in batches:  # a run for each, so the watermark moves in between
        spark.createDataFrame(batch, "k string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        counts = feeds.run_to_table(feeds.windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", "k"), "append", at)
    got = sorted((r["start"].hour, r["n"], r["total"]) for r in counts.collect())
    assert got == [(0, 1, 1.0), (9, 2, 3.0)]


def test_kept_results_follow_the_table(spark, tmp_path):
    at = str(tmp_path / "t")
    made = []
    build = lambda: made.append(1) or len(made)
    spark.range(3).write.parquet(at)
    assert session.kept(spark, at, "n", build) == session.kept(spark, at, "n", build) == 1
    spark.range(30_000).write.mode("overwrite").parquet(at)
    assert session.kept(spark, at, "n", build) == 2


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="shar"):
        session.checkpoint_dir(Session())


def test_hybrid_search_in_blocks(spark):
    docs = [("a", "red lamp", 0, 4.0, 5.0, "Home"), ("b", "red", 1, 5.0, 20.0, "garden"), ("c", "kettle", 2, 4.5, 8.0, "home"), ("d", None, 3, None, None, None), ("e", "red", 4, 5.0, 5.0, "home"), ("f", "red", None, 5.0, 5.0, "home")]
    docs = spark.createDataFrame(docs, "doc_id string, text string, row_id long, rating double, value double, category string")
    pictures = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [0.6, 0.8]), ("e", [1.0])], "doc_id string, v array<double>")
    asked = [(1, "red lamp", True, [1.0, 0.0], None, "", None), (2, "red", True, None, 10.0, "HOME", ["a"]), (3, "", False, [2.0, 0.0], None, None, None), (4, "", False, None, None, "home", ["c"]), (5, "none", True, None, None, None, None), (6, "", False, None, None, None, None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, has_text boolean, qv array<double>, max_value double, category string, excluded array<string>")
    index = Hybrid.build(docs, X.tokenize, pictures)
    got = {}
    for r in index.search(queries, lexical.query_terms(queries, "query_id", X.tokenize(F.col("query"))), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == {1: [("a", 0.65), ("b", 0.5921), ("e", 0.2421)], 2: [("e", 0.65), ("f", 0.65)], 3: [("b", 1.0), ("d", 0.6), ("c", 0.0)], 4: [("e", 1.0), ("f", 1.0), ("a", 0.8)], 6: [("b", 1.0), ("e", 1.0), ("f", 1.0)]}
    plan = QUERIES["hybrid_search_H2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan  # no tables of all scores are joined
