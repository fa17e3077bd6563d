import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import dataset, planner, sessions
from quillstone.operators.versions import Versions
from quillstone.sources import catalog as S


def products(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", s, "license", p) for i, s, p in rows], "id string, title string, source string, license string, price double").withColumn("stock", F.lit(1))


def test_validation(spark, rows):
    bad = products(spark, [("a", "s", 1.0), ("a", "s", 1.0), ("b", " ", 1.0), ("c", "s", -1.0), (None, "s", 1.0)])
    assert rows(dataset.violations(bad)) == [("a", "repeated id"), ("b", "no source"), ("c", "negative price"), (None, "no id")]
    with pytest.raises(ValueError, match="b: no source"):
        dataset.validate(bad.where("id = 'b'"))
    assert dataset.prepare(products(spark, [("a", "s", 1.0)])).first()["split"] in ("train", "validation", "test")
    assert rows(dataset.violations(bad.limit(0))) == []


def test_content_copies(spark, rows):
    data = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "id long, t string")
    assert rows(dataset.canonical_content(data, "id", "t").select("id", "canonical", "copies")) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]
    made = data.select("id", F.col("t").alias("image"), F.lit("train").alias("split"))
    assert dataset.summary(made, "id", "image", "split").first().asDict() == {"products": 4, "images": 1, "repeated_images": 1, "train": 4, "validation": 0, "test": 0}


def test_listings(spark, rows, tmp_path):
    value = lambda v, tag="en_US": [{"language_tag": tag, "value": v}]
    listings = [
        {"item_id": "1", "domain_name": "shop", "main_image_id": "m1", "other_image_id": ["x", "o2", "o1"], "product_type": "SHOES", "item_name": value("White") + value("白色运动鞋", "zh_CN"), "bullet_point": value("<b>轻量</b>通勤", "zh_CN"), "brand": value("")},
        {"item_id": "2", "main_image_id": "lost", "item_name": value("t")},
        {"item_id": "3", "main_image_id": "m1", "item_name": value("")},
    ]
    with gzip.open(tmp_path / "listings_0.json.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(x) for x in listings) + "\n\n")
    with gzip.open(tmp_path / "images.csv.gz", "wt") as f:
        f.write("image_id,height,width,path\nm1,1,1,a/m1.jpg\no1,1,1,a/o1.jpg\no2,1,1,a/o2.jpg\n")
    read, images = S.read_listings(spark, str(tmp_path / "listings_*.json.gz")), S.read_image_paths(spark, str(tmp_path / "images.csv.gz"))
    made = dataset.convert_listings(read, images, "src", "CC")
    assert rows(made.select("id", "title", "category", "description", "stock")) == [("shop:1", "白色运动鞋", "SHOES", "轻量 通勤", 1)]
    assert dataset.listing_counts(read, images).first().asDict() == {"converted": 1, "skipped_missing_image": 1, "skipped_missing_title": 1}
    cases = dataset.cross_view_cases(read, images, made.withColumn("split", F.lit(None).cast("string")))
    assert rows(cases) == [("cross-view-shop:1", "a/o2.jpg", "shop:1")]
    assert rows(dataset.pending_images(read, images)) == [("lost",)]


def test_sources(spark, rows, tmp_path):
    line = {"id": "a", "title": "t", "attributes": {"k": "v"}, "price": 1.5}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\n\n")
    (tmp_path / "c.json").write_text(json.dumps([line]))
    (tmp_path / "c.csv").write_text("﻿id,title,price\na,t,1.5\n", encoding="utf-8")
    want = [("a", "t", 1.5)]
    assert rows(S.read_jsonl(spark, str(tmp_path / "c.jsonl")).select("id", "title", "price")) == want
    assert rows(S.read_json_array(spark, str(tmp_path / "c.json")).select("id", "title", "price")) == want
    assert rows(S.read_raw(spark, str(tmp_path / "c.csv"), "id string, title string, price double")) == want
    with pytest.raises(ValueError, match="unknown"):
        S.read_raw(spark, "x.xml", "id string")
    (tmp_path / "i").mkdir()
    (tmp_path / "i/red.ppm").write_bytes(b"P6 2 2 255 " + bytes([255, 0, 0] * 4))
    (tmp_path / "i/bad.ppm").write_bytes(b"nothing")
    seen = {r["path"].rsplit("/", 1)[1]: r["descriptor"] for r in S.read_image_vectors(spark, str(tmp_path / "i")).collect()}
    assert len(seen["red.ppm"]) == 51 and np.isclose(np.linalg.norm(seen["red.ppm"]), 1) and seen["bad.ppm"] is None
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    ids = spark.range(3).select(F.col("id").alias("row_id"))
    got = S.write_npy_vectors(spark, str(tmp_path / "v.npy"), ids, str(tmp_path / "vectors"))
    assert rows(got.select("row_id", F.col("vector")[1])) == [(0, 0.0), (1, 1.0), (2, 0.0)]
    with pytest.raises(ValueError):
        S.write_npy_vectors(spark, str(tmp_path / "v.npy"), ids.limit(2), str(tmp_path / "x"))


def test_change_log_and_encoding_cache(spark, rows, tmp_path):
    log = str(tmp_path / "log")
    change = spark.createDataFrame([(1, "delete", "a", None, "s"), (2, "delete", "b", None, "s")], S.CHANGES)
    S.append_changes(change, log)
    assert rows(S.read_changes(spark, log, 1).select("product_id")) == [("b",)]
    assert S.last_seq(S.read_changes(spark, log)).first()[0] == 2
    items = spark.createDataFrame([("k1", "old"), ("k2", "new"), ("k3", "new")], "key string, text string")
    cache = spark.sql("select sha2('old', 256) content, array(9d) vector")
    assert rows(S.encode_missing(items, cache, lambda texts: [[len(t)] for t in texts], 1)) == [("k1", [9.0]), ("k2", [3.0]), ("k3", [3.0])]


def test_versions(spark, tmp_path):
    root = Versions(str(tmp_path))
    one = spark.createDataFrame([("a", 1.0)], "id string, price double")
    with pytest.raises(ValueError):
        root.read(spark, "catalog")
    first, second = root.write({"catalog": one}), root.write({"catalog": one.union(one)})
    root.promote(first)
    root.promote(second)
    assert root.read(spark, "catalog").count() == 2
    assert root.rollback() == first and root.current() == first
    with pytest.raises(ValueError):
        root.rollback()
    (tmp_path / "v9").mkdir()
    with pytest.raises(ValueError, match="incomplete"):
        root.promote(9)
    assert root.prune(1) == [second] and root.current() == first


def turns(spark, texts, session="s"):
    return spark.createDataFrame([(session, i, t) for i, t in enumerate(texts)], "session_id string, turn long, text string")


def test_session_slots(spark, rows):
    said = turns(spark, ["想找500元以内的 shoe-001", "那有货吗", None, "1000元以内的 bag-002"])
    assert rows(sessions.slots(said).select("turn", "max_price", "n_ids")) == [(0, 500.0, 1), (1, 500.0, 1), (2, 500.0, 1), (3, 1000.0, 2)]
    both = said.union(turns(spark, ["看看 pan-10", "不要这个", "不要 lamp-22"], "t"))
    assert rows(sessions.fold_sessions(both)) == [("s", 4, ["shoe-001", "bag-002"], []), ("t", 3, ["pan-10", "lamp-22"], ["pan-10", "lamp-22"])]
    assert rows(sessions.fold_sessions(said.limit(0))) == []


def test_windows_never_exceed_their_size(spark):
    said = turns(spark, ["想看看轻便一点的运动鞋" * 3, "abc " * 80, None, "", "有货吗" * 200])
    for usable in (20, 64, 400, 5000):
        got = sessions.context_windows(said, usable).first()
        assert got["tokens"] <= usable and got["kept"] + got["dropped"] == 5
    kept, folded, tokens = sessions.compress(["一" * 30, "二" * 30], 50)
    assert kept == ["二" * 30] and tokens <= 50 and sessions.compress(kept, 50)[0] == kept
    assert sessions.compress([], 10) == ([], [], 0)


def test_versioned_save(spark, rows):
    store = spark.createDataFrame([("a", 2, "old"), ("b", 1, "old")], "session_id string, version int, slots string")
    updates = spark.createDataFrame([("a", 2, "new"), ("b", 0, "stale"), ("c", 0, "first")], "session_id string, read_version int, slots string")
    assert rows(sessions.versioned_save(store, updates)) == [("a", 3, "new"), ("b", 1, "old"), ("c", 1, "first")]


def test_planner(spark, rows):
    asked = spark.createDataFrame([("1", "对比500元以内的跑步运动鞋", "auto", None), ("2", "有货吗", None, ["x"]), ("3", "运动鞋", "inventory", ["x", "x", "y"]), ("4", None, None, None)], "id string, query string, requested_intent string, tags array<string>")
    names = spark.createDataFrame([("运动鞋",), ("跑步运动鞋",), (None,), ("运动鞋",)], "category string")
    plans = planner.plan_queries(asked, names)
    assert rows(plans) == [("1", "compare", 500.0, "跑步运动鞋"), ("2", "inventory", None, None), ("3", "inventory", None, "运动鞋"), ("4", "search", None, None)]
    expected = asked.withColumn("expected", F.expr("named_struct('intent', 'inventory', 'max_price', cast(null as double), 'category', cast(null as string))"))
    got = {r["tag"]: (r["cases"], r["joint"]) for r in planner.planner_accuracy(expected, plans).collect()}
    assert got == {None: (4, 0.25), "x": (2, 0.5), "y": (1, 0.0)}


def test_guard_and_citations(spark, rows):
    ask = spark.createDataFrame([(1, 500.0, "x", 9, ["a"]), (2, None, "x", 2, None)], "query_id long, max_value double, category string, top_k int, excluded array<string>")
    state = spark.createDataFrame([(1, 300.0, "y", 5, ["b"])], ask.schema)
    assert rows(planner.tightened(ask, state)) == [(1, 300.0, "y", 3, ["a", "b"]), (2, None, "x", 2, [])]
    said = spark.createDataFrame([("推荐 [a-01]，不选 [b-02]", ["a-01", "a-01", "b-02", "c-03"], ["b-02"])], "answer string, seen array<string>, excluded array<string>")
    assert planner.citations(said).first()["citations"] == ["a-01"]


def test_streams_match_tables(spark, rows, tmp_path):
    from quillstone.operators.changefeed import latest_changes
    from quillstone.streaming import feeds

    data = spark.createDataFrame([(i, (i * 7) % 50, "delete" if i % 5 == 0 else "upsert", f"k{i % 9}") for i in range(120)], "log_pos long, seq long, op string, product_id string")
    feed = data.withColumn("product", F.expr(f"if(op = 'delete', null, named_struct({', '.join(repr(f.split()[0]) + ', cast(' + ('product_id' if f.split()[0] == 'id' else 'null') + ' as ' + f.split()[1] + ')' for f in S.CATALOG.replace('string,string', 'string;string').split(', '))}))".replace(";", ",")))
    feed.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.stream_changes(stream, str(tmp_path / "state"), str(tmp_path / "progress")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    assert last == 3
    state = spark.read.parquet(str(tmp_path / f"state/{last}")).where("__live").select("__key", "__seq", "__pos")
    assert rows(state) == rows(latest_changes(feed))


def test_text_helpers(spark):
    row = spark.createDataFrame([({"k": "v", "e": ""}, "c")], "a map<string,string>, c string")
    assert row.select(X.attribute_question(F.col("a"), F.col("c"))).first()[0] == "想找一款v的c，请推荐符合这些属性的商品"
    assert row.select(X.product_document(F.col("c"), F.lit(None).cast("string"), F.lit(""), F.map_filter("a", lambda k, v: v != ""))).first()[0] == "c。。k v"


def test_report_of_too_many_rows(spark, tmp_path):
    S.write_report(spark.range(1000), str(tmp_path / "whole.md"))
    assert len((tmp_path / "whole.md").read_text().splitlines()) == 1002
    with pytest.raises(ValueError, match="1,000 rows"):
        S.write_report(spark.range(1001), str(tmp_path / "long.md"))
    assert not (tmp_path / "long.md").exists()
