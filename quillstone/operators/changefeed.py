"""Ordered replay of a change feed: inserts, updates and deletes, late, repeated or out of order.

Each change becomes a *state row*: the stamp (seq, position) of the last change it contains, whether the row is live
after it, the stamp of the last delete, and for every payload column a value with the stamp that set it. Merging state
rows of a key gives another state row, and merging is associative, commutative and idempotent. So the replay runs twice
with the same state machine: once over every input partition, sorted by key and sequence (nothing is shuffled, a key
with a third of all changes shrinks to one row for each partition), and once after a repartition by key over those
partial states. A stamp that a state already contains changes nothing, so redelivered changes are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING_OPS = ("insert", "update", "upsert")
DELETE_OP = "delete"
LEAST = np.iinfo(np.int64).min


def plain(text: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def valid_changes(changes: DataFrame, key: str = "product_id", payload: str = "product", payload_key: str = "id") -> DataFrame:
    """The well-formed changes. A null seq or key, an unknown op, a set without a payload of the same key, and a delete
    with a payload are malformed."""
    op = plain(F.col("op"))
    sets = op.isin(*SETTING_OPS) & (F.col(f"{payload}.{payload_key}") == F.col(key))
    return changes.where(F.col("seq").isNotNull() & F.col(key).isNotNull() & (sets | ((op == DELETE_OP) & F.col(payload).isNull())))


def _stamp_names(columns: Sequence[str]) -> list[str]:
    return ["__seq", "__pos", "__live", "__dseq", "__dpos", *(f"__{x}{i}" for i in range(len(columns)) for x in ("v", "s", "p"))]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LEAST).to_numpy()


def merge_states(rows: pa.Table, columns: int) -> pa.Table:
    """One state row for each key: the state machine, run over rows in any order."""
    if rows.num_rows == 0:
        return rows
    code = rows["__key"].combine_chunks().dictionary_encode().indices.to_numpy()
    keys = int(code.max()) + 1

    def last(seq: np.ndarray, pos: np.ndarray) -> np.ndarray:
        order = np.lexsort((pos, seq, code))
        ends = np.flatnonzero(np.append(np.diff(code[order]) != 0, True))
        return order[ends]

    newest = last(_numbers(rows["__seq"]), _numbers(rows["__pos"]))
    out = {x: rows[x].take(newest) for x in ("__key", "__seq", "__pos", "__live")}
    dseq, dpos = _numbers(rows["__dseq"]), _numbers(rows["__dpos"])
    deleted = last(dseq, dpos)
    out |= {"__dseq": rows["__dseq"].take(deleted), "__dpos": rows["__dpos"].take(deleted)}
    gone_seq, gone_pos = np.empty(keys, np.int64), np.empty(keys, np.int64)
    gone_seq[code[deleted]], gone_pos[code[deleted]] = dseq[deleted], dpos[deleted]
    for i in range(columns):
        seq, pos = _numbers(rows[f"__s{i}"]), _numbers(rows[f"__p{i}"])
        picked = last(seq, pos)
        at = code[picked]
        holds = (seq[picked] > gone_seq[at]) | ((seq[picked] == gone_seq[at]) & (pos[picked] > gone_pos[at]))
        index = pa.array(picked, mask=~holds)
        out |= {x: rows[x].take(index) for x in (f"__v{i}", f"__s{i}", f"__p{i}")}
    return pa.table(out).select(rows.column_names)


def _replay(columns: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last key's state: its changes may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_arrays(batch.columns, batch.schema.names)  # all nullable, as states are
            state = merge_states(pa.concat_tables([held, rows]) if held is not None else rows, columns)
            if state.num_rows > 1:
                yield from state.slice(0, state.num_rows - 1).combine_chunks().to_batches()
            held = state.slice(state.num_rows - 1) if state.num_rows else held
        if held is not None and held.num_rows:
            yield from held.combine_chunks().to_batches()

    return run


def replay(changes: DataFrame, key: str, live: Column, payload: Sequence[Column] = (), seq: str = "seq", position: str = "log_pos", prior: DataFrame | None = None) -> DataFrame:
    """States (__key, __seq, __pos, __live, …) after all changes of each key.

    live: false for a delete. payload: the columns that a change sets; a null leaves the value as it was, and a delete
    clears all. prior: states of an earlier replay, to go on from; changes that they contain are skipped. Rows need a
    key and seq; a null position counts as the lowest. Equal stamps with different payloads: either may stay.
    """
    stamp = [F.col(seq).cast("long"), F.coalesce(F.col(position).cast("long"), F.lit(LEAST + 1))]
    values = []
    for i, value in enumerate(payload):
        there = live & value.isNotNull()
        values += [F.when(there, value).alias(f"__v{i}"), F.when(there, stamp[0]).alias(f"__s{i}"), F.when(there, stamp[1]).alias(f"__p{i}")]
    rows = changes.select(
        F.col(key).alias("__key"), stamp[0].alias("__seq"), stamp[1].alias("__pos"), live.alias("__live"), F.when(~live, stamp[0]).alias("__dseq"), F.when(~live, stamp[1]).alias("__dpos"), *values
    ).where(F.col("__key").isNotNull() & F.col("__seq").isNotNull())
    schema = T.StructType([T.StructField(x.name, x.dataType, True) for x in rows.schema])
    run = _replay(len(payload))
    partial = rows.sortWithinPartitions("__key", "__seq", "__pos").mapInArrow(run, schema)
    if prior is not None:
        partial = partial.unionByName(prior.select(*schema.names))
    return partial.repartition("__key").sortWithinPartitions("__key", "__seq", "__pos").mapInArrow(run, schema)


def latest_changes(changes: DataFrame) -> DataFrame:
    """(product_id, seq, log_pos) of the change that takes effect last, for each product that exists after all of them.

    Malformed changes are ignored; an empty feed gives no rows; extra columns are not read.
    """
    feed = valid_changes(changes).select("product_id", "seq", "log_pos", plain(F.col("op")).alias("op"))
    state = replay(feed, "product_id", F.col("op") != DELETE_OP)
    return state.where("__live").select(F.col("__key").alias("product_id"), F.col("__seq").alias("seq"), F.col("__pos").alias("log_pos"))


def apply_changes(base: DataFrame, changes: DataFrame, partial_updates: bool = False) -> DataFrame:
    """The catalog after all valid changes, with base's columns; columns that changes don't carry keep base's value.

    A set replaces the product, or with partial_updates only the columns that aren't null in it (the rest stay as they
    were since the last delete). A deleted product is left out; deleting an unknown one has no effect. Products of base
    with a null id stay as they are. Base's ids are unique; duplicates of an untouched id stay, too.
    """
    fields = [f.name for f in changes.schema["product"].dataType if f.name in base.columns and f.name != "id"]
    feed = valid_changes(changes).withColumn("__op", plain(F.col("op")))
    payload = [F.col("product")[f] for f in fields] if partial_updates else [F.col("product")]
    state = replay(feed, "product_id", F.col("__op") != DELETE_OP, payload)
    # Columns are named through their tables, as base may have columns of the same names.
    whole = base.join(state, base["id"] == state["__key"], "full_outer").where(state["__live"].isNull() | state["__live"])
    changed = state["__key"].isNotNull()

    def value(name: str) -> Column:
        if name == "id":
            return F.coalesce(state["__key"], base["id"])
        if name not in fields:
            return base[name]
        if not partial_updates:
            return F.when(changed, state["__v0"][name]).otherwise(base[name])
        i = fields.index(name)
        return F.when(state[f"__s{i}"].isNotNull(), state[f"__v{i}"]).when(changed & state["__dseq"].isNotNull(), F.lit(None)).otherwise(base[name])

    return whole.select(*(value(c).alias(c) for c in base.columns))


def change_stats(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: counts of valid and malformed changes, and of products inserted, updated, deleted, and untouched deletes."""
    feed = valid_changes(changes).select("product_id", "seq", "log_pos", plain(F.col("op")).alias("op"))
    state = replay(feed, "product_id", F.col("op") != DELETE_OP)
    known = base.where("id is not null").select(F.col("id").alias("__id")).distinct()
    outcome = state.join(known, state["__key"] == F.col("__id"), "left")
    had = F.col("__id").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    totals = changes.agg(F.count(F.lit(1)).alias("changes")).crossJoin(feed.agg(F.count(F.lit(1)).alias("valid")))
    return totals.crossJoin(outcome.agg(n(F.col("__live") & ~had, "inserted"), n(F.col("__live") & had, "updated"), n(~F.col("__live") & had, "deleted"), n(~F.col("__live") & ~had, "deleted_unknown")))
