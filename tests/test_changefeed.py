import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import changefeed
from quillstone.sources.catalog import CATALOG

FEED = f"log_pos long, seq long, op string, product_id string, product struct<{CATALOG.replace(' string', ':string').replace(' double', ':double').replace(' map', ':map').replace(' int', ':int')}>, source string"
NONE = (None,) * 8


def product(id, title="t", category="c", description="d", price=1.0):
    return (id, title, category, description, price, {"a": "b"}, *NONE[:7])


def feed(spark, changes):
    return spark.createDataFrame([(p, s, op, i, x, "src") for p, s, op, i, x in changes], FEED)


CHANGES = [
    (1, 10, "upsert", "a", product("a", "one")),
    (2, 12, " UPDATE ", "a", product("a", "three")),
    (3, 11, "insert", "a", product("a", "two")),
    (4, 12, "update", "a", product("a", "tie wins")),
    (5, 5, "insert", "b", product("b")),
    (6, 6, "Delete", "b", None),
    (7, 7, "delete", "unknown", None),
    (8, 8, "upsert", "c", product("c")),
    (9, 8, "upsert", "c", product("c")),
    (10, 99, "noop", "c", product("c")),
    (11, 99, "upsert", "c", product("other")),
    (12, 99, "delete", "c", product("c")),
    (13, 99, "upsert", "c", None),
    (14, None, "upsert", "c", product("c")),
    (15, 99, "upsert", None, product("c")),
    (16, 99, None, "c", product("c")),
]


def test_latest_takes_effect_by_seq_then_position(spark, rows):
    got = rows(changefeed.latest_changes(feed(spark, CHANGES)))
    assert got == [("a", 12, 4), ("c", 8, 9)]


def test_order_and_redelivery_do_not_matter(spark, rows):
    changes = CHANGES * 3
    random.Random(3).shuffle(changes)
    assert rows(changefeed.latest_changes(feed(spark, changes).repartition(5))) == [("a", 12, 4), ("c", 8, 9)]


def test_empty_feed(spark, rows):
    assert rows(changefeed.latest_changes(feed(spark, []))) == []


def test_catalog_after_changes(spark, rows):
    base = spark.createDataFrame([product("b"), product("z", None), product(None, "no id")], CATALOG).withColumn("row_id", F.lit(7)).withColumn("__live", F.lit("mine")).withColumn("__key", F.lit(1))
    got = changefeed.apply_changes(base, feed(spark, CHANGES))
    assert got.columns == base.columns
    assert rows(got.select("id", "title", "row_id", "__live")) == sorted([("a", "tie wins", None, None), ("c", "t", None, None), ("z", None, 7, "mine"), (None, "no id", 7, "mine")], key=repr)


def test_changes_on_an_empty_base_and_none_on_a_full_one(spark, rows):
    base = spark.createDataFrame([product("b")], CATALOG)
    assert rows(changefeed.apply_changes(base.limit(0), feed(spark, CHANGES)).select("id")) == [("a",), ("c",)]
    assert rows(changefeed.apply_changes(base, feed(spark, [])).select("id", "price")) == [("b", 1.0)]


def test_partial_updates_keep_columns_since_the_last_delete(spark, rows):
    changes = [
        (1, 1, "upsert", "a", product("a", "t1", "c1", "d1")),
        (4, 4, "update", "a", product("a", None, "c4", None, None)),
        (3, 3, "update", "a", product("a", "t3", None, None, 3.0)),
        (5, 1, "upsert", "b", product("b", "old", "old", "old")),
        (6, 2, "delete", "b", None),
        (7, 3, "update", "b", product("b", "new", None, None, None)),
        (8, 3, "update", "base", product("base", None, "c", None, None)),
    ]
    base = spark.createDataFrame([product("base", "kept")], CATALOG)
    got = changefeed.apply_changes(base, feed(spark, changes), partial_updates=True)
    assert rows(got.select("id", "title", "category", "description", "price")) == [("a", "t3", "c4", "d1", 3.0), ("b", "new", None, None, None), ("base", "kept", "c", "d", 1.0)]


def test_resume_from_a_prior_state(spark, rows):
    live = F.col("op") != "delete"
    whole = [(1, 1, "upsert", "a"), (2, 5, "delete", "a"), (3, 2, "upsert", "b"), (4, 3, "delete", "c")]
    frame = lambda part: spark.createDataFrame(part, "log_pos long, seq long, op string, product_id string")
    first = changefeed.replay(frame(whole[1:]), "product_id", live)
    again = changefeed.replay(frame(whole), "product_id", live, prior=first)
    assert rows(again.select("__key", "__seq", "__live")) == [("a", 5, False), ("b", 2, True), ("c", 3, False)]


def test_a_hot_key_shrinks_before_the_shuffle(spark):
    changes = spark.range(30_000).select(F.col("id").alias("log_pos"), F.col("id").alias("seq"), F.lit("upsert").alias("op"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("product_id"))
    state = changefeed.replay(changes.repartition(6), "product_id", F.col("op") != "delete")
    assert state.count() == 20_001
    assert state.where("__key = 'hot'").first()["__seq"] == 29_997


def test_stats(spark):
    base = spark.createDataFrame([product("a"), product("b")], CATALOG)
    got = changefeed.change_stats(base, feed(spark, CHANGES)).first().asDict()
    assert got == {"changes": 16, "valid": 9, "inserted": 1, "updated": 1, "deleted": 1, "deleted_unknown": 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_sequential_application(spark, rows, seed):
    rng = random.Random(seed)
    changes = []
    for pos in range(400):
        key = f"k{rng.randrange(12)}"
        sets = rng.random() < 0.7
        changes.append((pos, rng.randrange(60), "upsert" if sets else "delete", key, product(key, f"v{pos}") if sets else None))
    state = {}
    for pos, seq, op, key, value in sorted(changes, key=lambda c: (c[1], c[0])):
        state[key] = (seq, pos, op)
    want = sorted((k, s, p) for k, (s, p, op) in state.items() if op == "upsert")
    rng.shuffle(changes)
    assert rows(changefeed.latest_changes(feed(spark, changes).repartition(4))) == want
