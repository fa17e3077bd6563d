"""Packing documents into containers of a fixed number of tokens, online, by the sum of squares.

A level array counts the partly filled containers of each fill level. A document goes to the level where the sum of the
squared counts grows least, which keeps all levels rare and lets containers fill up exactly. Each task packs the rows of
its partition as they come; then the documents of containers that aren't nearly full are packed once more, together with
those of up to GROUP other partitions, largest first. A document longer than a container fills whole ones, and its rest
is packed like a document; no other document is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.tokens import VOCABULARY, count_tokens

CAPACITY = 2048
#: Containers with at most this share of room left aren't opened again.
ROOM = 0.002
#: Partitions whose leftovers are packed together.
GROUP = 64


class SumOfSquares:
    """Online packing; put() returns the container's number."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fills: list[int] = []

    def put(self, size: int) -> int:
        room = self.capacity - size
        old, new = self.counts[1 : room + 1], self.counts[size + 1 : self.capacity + 1]
        at = -1
        if room > 0:
            growth = np.where(old > 0, 2 * (new - old) + 2, 1 << 60)
            growth[-1] = 1 - 2 * old[-1] if old[-1] else 1 << 60  # a full container leaves the levels
            at = int(growth.argmin())
            if growth[at] > 2 * self.counts[size] + 1:
                at = -1
        if at < 0:
            number, level = len(self.fills), size
            self.fills.append(size)
        else:
            level = at + 1
            number = self.open[level].pop()
            self.counts[level] -= 1
            level += size
            self.fills[number] = level
        if level < self.capacity:
            self.open[level].append(number)
            self.counts[level] += 1
        return number


def _parts(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(id, part number, start, size): a document in one part, or cut into whole containers and the rest."""
    n = np.maximum(1, -(-sizes // capacity))
    owner = np.repeat(np.arange(len(ids)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return ids[owner], number, number * capacity, np.minimum(capacity, sizes[owner] - number * capacity)


PACKED = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("part_no", T.IntegerType()), ("start_token", T.LongType()), ("n_tokens", T.LongType()), ("container", T.LongType()), ("fill", T.LongType()), ("origin", T.LongType()))])
NAMES = PACKED.names


def _pack(capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = SumOfSquares(capacity), []
        for batch in batches:
            doc, part, start, size = _parts(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), capacity)
            held.append((doc, part, start, size, np.fromiter(map(packer.put, size.tolist()), np.int64, len(size)), np.full(len(doc), batch.column(2)[0].as_py() if len(doc) else 0)))
        if held:
            doc, part, start, size, container, origin = (np.concatenate(x) for x in zip(*held))
            fill = np.array(packer.fills, np.int64)[container]
            yield pa.record_batch([pa.array(x) for x in (doc, part.astype(np.int32), start, size, (origin << 32) | container, fill, origin)], names=NAMES)

    return run


def _repack(capacity: int):
    full = capacity - int(ROOM * capacity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = pa.array(batch.column(5).to_numpy(zero_copy_only=False) >= full)
            yield batch.filter(done)
            held.append(batch.filter(pa.compute.invert(done)))
        if not held:
            return
        rows = pa.Table.from_batches(held)
        group, size = rows["origin"].to_numpy() // GROUP, rows["n_tokens"].to_numpy()
        order = np.lexsort((rows["part_no"].to_numpy(), rows["doc_id"].to_numpy(), -size, group))
        rows, group, size = rows.take(pa.array(order)), group[order], size[order]
        for g in np.unique(group):
            of = np.flatnonzero(group == g)
            packer = SumOfSquares(capacity)
            container = np.fromiter(map(packer.put, size[of].tolist()), np.int64, len(of))
            part = rows.take(pa.array(of))
            names = pa.array(-1 - ((np.int64(g) << 32) | container))
            part = part.set_column(4, "container", names).set_column(5, "fill", pa.array(np.array(packer.fills, np.int64)[container]))
            yield from part.combine_chunks().to_batches()

    return run


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, start_token, n_tokens, container_id) from (doc_id, size) rows.

    A document with a null id or no tokens is in no container; repeated ids are packed as documents of their own.
    """
    rows = sizes.select(F.col("doc_id").cast("long"), F.col("size").cast("long")).where("doc_id is not null and size > 0").withColumn("origin", F.spark_partition_id().cast("long"))
    full = capacity - int(ROOM * capacity)
    first = rows.mapInArrow(_pack(capacity), PACKED)
    # Rows of full containers stay spread; leftovers of a group of partitions meet in one task.
    meet = F.when(F.col("fill") >= full, F.xxhash64("container")).otherwise(F.floor(F.col("origin") / GROUP))
    return first.repartition(meet).mapInArrow(_repack(capacity), PACKED).select("doc_id", "part_no", "start_token", "n_tokens", F.col("container").alias("container_id"))


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack_sizes() of the documents' sizes in tokens; null and empty texts are in no container."""
    return pack_sizes(documents.select(F.col(key).alias("doc_id"), count_tokens(F.col(text), vocabulary).alias("size")), capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room left, and how many containers are full or more than half empty."""
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    return fills.agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), (1 - F.sum("fill") / (F.count(F.lit(1)) * capacity)).alias("room_share"), F.count_if(F.col("fill") == capacity).alias("full"), F.count_if(F.col("fill") < capacity / 2).alias("half_empty"), F.max("fill").alias("most"))


def packing_check(documents: DataFrame, packed: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: how many documents are packed, whether each token of each is so once (whole), whether all containers hold what they
    can (fits), whether only longer documents are cut, and whether at most 1 % of the room is left, the last container aside (little_room)."""
    sizes = documents.select(F.col(key).cast("long").alias("doc_id"), count_tokens(F.col(text), vocabulary).alias("n")).where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("n").alias("longest"))
    parts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("found"), F.count(F.lit(1)).alias("parts"), F.max("part_no").alias("last"))
    per = sizes.join(parts, "doc_id", "full_outer")
    one = per.agg(F.count("n").alias("documents"), F.bool_and(F.col("n").eqNullSafe(F.col("found"))).alias("whole"), F.bool_and((F.col("last") == 0) | (F.col("longest") > capacity)).alias("cut_only_if_longer"))
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill")).agg(F.max("fill").alias("most"), F.sum("fill").alias("all"), F.count(F.lit(1)).alias("containers"))
    room = (F.col("containers") - 1) * capacity <= 1.01 * F.col("all")
    return one.crossJoin(fills).select("documents", "whole", (F.col("most") <= capacity).alias("fits"), "cut_only_if_longer", room.alias("little_room"))
