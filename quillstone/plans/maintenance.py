"""Queries of catalog maintenance: change feed, versions, dataset preparation."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quillstone.operators import changefeed
from quillstone.plans.registry import query
from quillstone.plans.relational import FOLD
from quillstone.session import fresh_folder, table

_VALID = """valid as (
  select *, lower(trim(op)) as op2 from catalog_changes
  where seq is not null and product_id is not null and (
    (lower(trim(op)) in ('insert','update','upsert') and product is not null and product.id = product_id)
    or (lower(trim(op)) = 'delete' and product is null))),
latest as (select * from valid qualify row_number() over (partition by product_id order by seq desc, log_pos desc) = 1)"""


@query("p1_found", f"with {_VALID} select product_id, seq, log_pos from latest where op2 <> 'delete'")
def p1_found(spark, d):
    return changefeed.latest_changes(table(spark, d, "catalog_changes"))


COLUMNS = ("title", "category", "description", "price", "image_path", "rating", "stock", "source", "license", "split", "image_sha256")
ENTRIES = "array_to_string(list_sort([e.key || '=' || coalesce(e.value, '') for e in map_entries({})]), ';')"


def _plain(whole):
    """All columns of a catalog; attributes as a text, as maps have no order."""
    entries = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return whole.select("id", *COLUMNS, F.array_join(entries, ";").alias("attributes"), "row_id")


@query(
    "p1_catalog",
    f"""with {_VALID}
select coalesce(l.product_id, p.id) as id, {", ".join(f"case when l.product_id is null then p.{c} else l.product.{c} end as {c}" for c in COLUMNS)},
  case when l.product_id is null then {ENTRIES.format("p.attributes")} else {ENTRIES.format("l.product.attributes")} end as attributes, p.row_id
from products p full outer join latest l on p.id = l.product_id where l.op2 is null or l.op2 <> 'delete'""",
)
def p1_catalog(spark, d):
    return _plain(changefeed.apply_changes(table(spark, d, "products"), table(spark, d, "catalog_changes")))


_LAST_SET = "case when t.{c} is not null then t.{c} when l.product_id is null or l.del is null then p.{c} end as {c}"


@query(
    "p1_partial",
    f"""with {_VALID}, stamped as (select *, seq::hugeint * 1000000000000 + log_pos as stamp from valid),
l as (select product_id, max(stamp) filter (op2 = 'delete') as del, arg_max(op2, stamp) as op2 from stamped group by product_id),
t as (select s.product_id, {", ".join(f"arg_max(s.product.{c}, s.stamp) filter (s.product.{c} is not null) as {c}" for c in COLUMNS)}, arg_max(s.product.attributes, s.stamp) filter (s.product.attributes is not null) as attributes
  from stamped s join l using (product_id) where s.op2 <> 'delete' and (l.del is null or s.stamp > l.del) group by s.product_id)
select coalesce(l.product_id, p.id) as id, {", ".join(_LAST_SET.format(c=c) for c in COLUMNS)},
  case when t.attributes is not null then {ENTRIES.format("t.attributes")} when l.product_id is null or l.del is null then {ENTRIES.format("p.attributes")} end as attributes, p.row_id
from products p full outer join l on p.id = l.product_id left join t on t.product_id = l.product_id where l.op2 is null or l.op2 <> 'delete'""",
)
def p1_partial(spark, d):
    """Changes that set single columns: a null leaves a column as it was since the last delete."""
    return _plain(changefeed.apply_changes(table(spark, d, "products"), table(spark, d, "catalog_changes"), partial_updates=True))


@query(
    "change_stats_E14",
    f"""with {_VALID}, seen as (select l.op2, p.id from latest l left join products p on p.id = l.product_id)
select (select count(*) from catalog_changes) as changes, (select count(*) from valid) as valid,
  count(*) filter (op2 <> 'delete' and id is null) as inserted, count(*) filter (op2 <> 'delete' and id is not null) as updated,
  count(*) filter (op2 = 'delete' and id is not null) as deleted, count(*) filter (op2 = 'delete' and id is null) as deleted_unknown from seen""",
)
def change_stats(spark, d):
    return changefeed.change_stats(table(spark, d, "products"), table(spark, d, "catalog_changes"))


@query("changes_since_L1", "select log_pos, seq, op, product_id from catalog_changes where seq > (select max(seq) - 1000 from catalog_changes)")
def changes_since(spark, d):
    changes = table(spark, d, "catalog_changes")
    newest = changes.agg((F.max("seq") - 1000).alias("mark"))
    return changes.join(F.broadcast(newest), F.col("seq") > F.col("mark")).select("log_pos", "seq", "op", "product_id")


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # A table is one file of the folder, or a folder of its own.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if os.path.isfile(path) else reader.parquet(path)


@query("stream_changes_L1", f"with {_VALID} select product_id, seq, log_pos from latest where op2 <> 'delete'")
def stream_changes(spark, d):
    from quillstone.streaming import feeds

    at = fresh_folder(spark, "feed")
    run = feeds.stream_changes(_stream(spark, d, "catalog_changes"), f"{at}/state", f"{at}/progress")
    run.awaitTermination()
    last = max(p["batchId"] for p in run.recentProgress if p["numInputRows"])
    state = spark.read.parquet(f"{at}/state/{last}").where("__live")
    return state.select(F.col("__key").alias("product_id"), F.col("__seq").alias("seq"), F.col("__pos").alias("log_pos"))


@query("stream_sessions_L2", f"with {FOLD}")
def stream_sessions(spark, d):
    from quillstone.streaming import feeds

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKS)
    at = fresh_folder(spark, "sessions")
    number = F.element_at(F.split("id", "-", 2), -1).cast("long")
    turns = _stream(spark, d, "planner_test").select(F.floor(number / 10).cast("string").alias("session_id"), (number % 10).alias("turn"), F.col("query").alias("text"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    with feeds.carried_code():
        feeds.stream_sessions(turns).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("session_id").agg(F.max_by(F.struct("turns", "seen"), "turns").alias("s"))
    return last.select("session_id", "s.turns", F.array_join("s.seen", ",").alias("seen"))


@query("stream_windows_L10", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def stream_windows(spark, d):
    """The windowed counts as a stream; the watermark is later than the newest event, so no row is late."""
    from quillstone.streaming import feeds

    counts = feeds.windowed_counts(_stream(spark, d, "events"), "ts", "event_type", late="36500 days")
    return feeds.run_to_table(counts, "complete", fresh_folder(spark, "windows")).withColumn("total", F.round("total", 6))


@query("stream_deduplicated_L10", "select distinct user_id from events")
def stream_deduplicated(spark, d):
    from quillstone.streaming import feeds

    once = feeds.deduplicated(_stream(spark, d, "events").select("user_id", "ts"), "user_id", "ts", late="36500 days")
    return feeds.run_to_table(once, "append", fresh_folder(spark, "once")).select("user_id")
