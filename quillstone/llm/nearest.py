"""The k most similar vectors of every vector, by multi-index hashing.

Rotations learned for each dimension (principal axes of a bounded sample, then iterative quantisation) give each vector a
binary code. A rotation yields at most as many bits as the dimension; where the code needs more, further rotations are
learned from other starts. The code is split into substrings, each an index of its own: a vector goes to one bucket of
every table. By the pigeonhole principle two codes within a Hamming radius of one less than the number of tables agree on a whole substring and so
meet in a bucket; there, candidates are chosen by single-precision products and reranked in double precision.

A substring has as many bits as keep a bucket near BUCKET rows, whatever the number of rows, so work grows in proportion
to the rows. More bits separate neighbours more often; so there are as many tables as find the share RECALL of the
neighbours at the cosine SIMILAR, at least TABLES (a bit of two vectors at an angle of a differs with chance a / pi).

A bucket of more than block(d) rows, such as near copies of one vector with one code, is compared whole as well: its rows
are dealt into blocks of about that many, and each pair of blocks is a group of its own. Rows that share a substring of
an earlier table are left out, as they met there.

Copies: a batch keeps the k + 1 smallest ids of each set of identical vectors; the further ones have k copies
at cosine 1 in the same batch and get those, so a vector that a third of all rows hold doesn't fill a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables, at least.
TABLES = 5
BUCKET = 4096
SIMILAR, RECALL = 0.97, 0.95
#: Candidates of a bucket that are reranked, beyond k.
SPARE = 3
#: Rows, about, that the rotations of a dimension are learned from.
SAMPLE = 8192
#: Rows of a block, at least and at most.
BLOCK = 8192, 32768
ROW = "g long, pair long, row binary"
NEAR = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("cosine", pa.list_(pa.float64()))])


@dataclass
class Model:
    """How a dimension's codes are made: tables substrings of bits signs each, of (x - mean) @ axes."""

    bits: int
    tables: int
    mean: np.ndarray
    axes: np.ndarray

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables)."""
        if not self.bits:
            return np.zeros((len(x), 1), np.int64)
        signs = ((x - self.mean) @ self.axes > 0).reshape(len(x), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def block(d: int) -> int:
    """Rows that a task compares with as many at a time: up to 8 MB of vectors of d elements, within BLOCK."""
    return min(BLOCK[1], max(BLOCK[0], (1 << 21) // d))


def table_count(bits: int) -> int:
    """Tables of substrings of so many bits that find the share RECALL of neighbours at SIMILAR; at least TABLES."""
    met = (1 - math.acos(SIMILAR) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - met))) if bits else 1


def _dealt(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each id, from a hash of it."""
    x = ids.astype(np.uint64)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(blocks)).astype(np.int64)


def unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, unit vectors) of the usable rows of columns id, v, d: a vector that isn't null, has d finite
    elements without nulls, and isn't all zeros; the id isn't null."""
    ids, vectors, dims = (batch.column(i) for i in range(3))
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = dims.fill_null(-2).to_numpy(zero_copy_only=False)
    good = (lengths == sizes) & (lengths > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == d))
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d)).astype(np.float64)
        scale = np.abs(x).max(axis=1)
        use = np.isfinite(scale) & (scale > 0) & np.isfinite(x).all(axis=1)
        x = x[use] / scale[use, None]
        yield int(d), numbers[rows[use]], x / np.linalg.norm(x, axis=1)[:, None]


def shortened(x: np.ndarray) -> np.ndarray:
    """Vectors as rows of bytes, 24-bit integers scaled to the full range: the precision of a float without its exponent,
    which a direction doesn't need."""
    whole = np.rint(x * (8388607 / np.abs(x).max(axis=1, keepdims=True))).astype("<i4")
    return np.ascontiguousarray(np.concatenate([(whole >> 8).astype("<i2").view(np.uint8), (whole & 255).astype(np.uint8)], axis=1))


def restored(raw: np.ndarray) -> np.ndarray:
    """Unit vectors of shortened() ones."""
    d = raw.shape[1] // 3
    x = np.ascontiguousarray(raw[:, : 2 * d]).view("<i2").astype(np.float64) * 256 + raw[:, 2 * d :]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, seed: int = 7, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d, bits): principal axes, rotated so that signs lose least; beyond d bits, by further rotations."""
    mean, d = sample.mean(axis=0), sample.shape[1]
    centred = sample - mean
    _, principal = np.linalg.eigh(centred.T @ centred)
    parts = []
    for at in range(0, bits, d):
        axes = principal[:, ::-1][:, : min(d, bits - at)]
        low = centred @ axes
        turn, _ = np.linalg.qr(np.random.default_rng(seed + at).standard_normal((axes.shape[1],) * 2))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ vt).T
        parts.append(axes @ turn)
    return mean, np.concatenate(parts, axis=1)


def _plain(d: int) -> Model:
    """The model of a dimension without a rotation: no bits, so one bucket."""
    return Model(0, 1, np.zeros(d), np.zeros((d, 0)))


def _bucket(d: int, t: int, part: np.ndarray) -> np.ndarray:
    """The number of a bucket: of dimension d, table t (below 256) and substring (below 2^32)."""
    return (np.int64(d * 256 + t) << 32) | part


def _encoder(models: dict[int, Model], blocks: dict[int, int] | None, k: int):
    """Rows (bucket, pair of blocks, id and vector) for each table; in rows of a negative bucket, ids of the neighbours
    instead of the vector, as they need no bucket. blocks: of the buckets that are dealt into blocks; if it is null, rows
    (bucket, rows in it) instead."""

    def rows_of(g: np.ndarray, pair: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        width = raw.shape[1]
        blob = pa.Array.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
        return pa.record_batch([pa.array(g), pa.array(pair), blob], names=["g", "pair", "row"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, x in unit_rows(batch):
                order = np.argsort(ids, kind="stable")
                ids, short = ids[order], shortened(x[order])
                _, same = np.unique(short.view(np.dtype((np.void, 3 * d))).ravel(), return_inverse=True)
                by = np.argsort(same, kind="stable")
                start = np.flatnonzero(np.append(True, np.diff(same[by]) != 0))
                nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
                spare = by[nth > k]
                if len(spare) and blocks is not None:
                    first = dict(zip(same[by[start]], start))
                    near = np.stack([ids[by[first[same[i]] : first[same[i]] + k]] for i in spare])
                    yield rows_of(-1 - ids[spare] % 4096, np.zeros(len(spare), np.int64), np.concatenate([ids[spare, None], near], axis=1).astype("<i8").view(np.uint8))
                keep = np.sort(by[nth <= k])
                ids, short = ids[keep], short[keep]
                parts = models.get(d, _plain(d)).substrings(restored(short))
                whole = np.concatenate([ids[:, None].astype("<i8").view(np.uint8), short], axis=1)
                for t in range(parts.shape[1]):
                    g = _bucket(d, t, parts[:, t])
                    if blocks is None:
                        found, n = np.unique(g, return_counts=True)
                        yield pa.record_batch([pa.array(found), pa.array(n)], names=["g", "n"])
                        continue
                    m = np.array([blocks.get(y, 1) for y in g.tolist()], np.int64) if blocks else np.ones(len(g), np.int64)
                    for size in np.unique(m):
                        rows = np.flatnonzero(m == size)
                        own = _dealt(ids[rows], size)
                        for other in range(size):
                            yield rows_of(g[rows], np.minimum(own, other) * size + np.maximum(own, other), whole[rows])

    return run


def _top(x: np.ndarray, single: np.ndarray, ids: np.ndarray, queries: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cosines of each query's best k of the others, itself left out; -1 where there are fewer."""
    scores = single[queries] @ single[others].T
    own = np.minimum(np.searchsorted(others, queries), len(others) - 1)
    itself = np.flatnonzero(others[own] == queries)
    scores[itself, own[itself]] = -3
    rows = np.arange(len(queries))
    best = np.empty((len(rows), min(k + SPARE, len(others))), np.int64)
    there = np.empty(best.shape, bool)
    for j in range(best.shape[1]):
        at = scores.argmax(axis=1)
        there[:, j] = scores[rows, at] > -2
        best[:, j] = others[at]
        scores[rows, at] = -3
    cosines = np.where(there, np.einsum("qd,qjd->qj", x[queries], x[best]), -3)
    order = np.lexsort((ids[best], -cosines), axis=1)[:, :k]
    best, cosines = np.take_along_axis(best, order, 1), np.take_along_axis(cosines, order, 1)
    best = np.where(cosines > -2, best, -1)
    lack = ((0, 0), (0, k - best.shape[1]))
    return np.pad(best, lack, constant_values=-1), np.pad(cosines, lack, constant_values=-3)


def _searcher(models: dict[int, Model], blocks: dict[int, int], k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        g, pair = (x.as_py() for x in key)
        raw = np.frombuffer(b"".join(rows["row"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        ids = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
        if g < 0:
            near = np.ascontiguousarray(raw[:, 8:]).view("<i8")
            counts = np.arange(len(ids) + 1, dtype=np.int32) * near.shape[1]
            return pa.table([pa.array(ids), pa.ListArray.from_arrays(counts, pa.array(near.ravel())), pa.ListArray.from_arrays(counts, pa.array(np.ones(near.size)))], schema=NEAR)
        d, t = divmod(g >> 32, 256)
        n, size, x = len(ids), blocks.get(g, 1), restored(raw[:, 8:])
        parts = models.get(d, _plain(d)).substrings(x)[:, :t]
        order = np.lexsort((ids, *parts.T))
        ids, x, parts = ids[order], x[order], parts[order]
        single = x.astype(np.float32)
        a, b = divmod(pair, size)
        mine = _dealt(ids, size) == a
        sides = [(np.arange(n),) * 2] if a == b else [(np.flatnonzero(mine), np.flatnonzero(~mine)), (np.flatnonzero(~mine), np.flatnonzero(mine))]
        out = [(np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty((0, k)))]
        step = max(1, min(1024, (1 << 23) // max(1, n)))
        for asked, there in sides:
            for i in range(0, len(asked), step):
                queries, others = asked[i : i + step], there
                if t and (parts[queries[0]] == parts[queries[-1]]).all():  # what all of them met in an earlier table needn't be compared
                    others = there[(parts[there] != parts[queries[0]]).all(axis=1)]
                if len(others):
                    out.append((queries, *_top(x, single, ids, queries, others, k)))
        queries, best, cosines = (np.concatenate(p) for p in zip(*out))
        keep = best >= 0
        for s in parts.T:  # pairs that met in an earlier table were ranked there
            keep &= s[queries][:, None] != s[best]
        counts = np.append(0, np.cumsum(keep.sum(axis=1))).astype(np.int32)
        found = pa.table([pa.array(ids[queries]), pa.ListArray.from_arrays(counts, pa.array(ids[best[keep]])), pa.ListArray.from_arrays(counts, pa.array(cosines[keep]))], schema=NEAR)
        return found.filter(pa.array(np.diff(counts) > 0))

    return run


def _ranker(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near, cosine = [], [], []
        for b in batches:
            ids.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)))
            near.append(b.column(1).flatten().to_numpy(zero_copy_only=False))
            cosine.append(b.column(2).flatten().to_numpy(zero_copy_only=False))
        if not ids:
            return
        i, n, c = map(np.concatenate, (ids, near, cosine))
        order = np.lexsort((n, -c, i))
        i, n, c = i[order], n[order], c[order]
        again = np.lexsort((-c, n, i))  # a pair counts once
        once = np.ones(len(i), bool)
        once[again[1:]] = (np.diff(i[again]) != 0) | (np.diff(n[again]) != 0)
        i, n, c = i[once], n[once], c[once]
        start = np.flatnonzero(np.append(True, np.diff(i) != 0)) if len(i) else np.empty(0, int)
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) + 1
        top = rank <= k
        yield pa.record_batch([pa.array(i[top]), pa.array(rank[top].astype(np.int32)), pa.array(n[top]), pa.array(c[top])], names=["vec_id", "rank", "neighbour", "cosine"])

    return run


def _models(usable: DataFrame, counts: dict[int, int], bucket: int, seed: int) -> dict[int, Model]:
    """A model for each dimension with more than about a bucket of rows, from a sample of bounded size."""
    wanted = {d: max(0, round(math.log2(n / bucket))) for d, n in counts.items()}
    if not any(wanted.values()):
        return {}
    share = F.create_map(*(F.lit(x) for d, n in counts.items() if wanted[d] for x in (d, min(1.0, SAMPLE / n))))
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share[F.col("d")] * (1 << 20))
    samples: dict[int, list[np.ndarray]] = {}
    for batch in chosen.toArrow().to_batches():
        for d, _, x in unit_rows(batch):
            samples.setdefault(d, []).append(x)
    models = {}
    for d, found in samples.items():
        x, bits = np.concatenate(found), min(31, wanted[d])
        if len(x) > 1:
            tables = table_count(bits)
            models[d] = Model(bits, tables, *learn_rotation(x, bits * tables, seed))
    return models


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "vectors", dimension: str = "dimension", k: int = 5, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, rank, neighbour, cosine): the k nearest rows of the same dimension for each usable row, nearly all of them found.

    Unusable vectors (see unit_rows) are in no result, a row alone in its dimension has no neighbours, ties in cosine go
    to the smaller id. Keys are unique.
    """
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(dimension).cast("int").alias("d"))
    usable = named.where("d > 0 and id is not null and size(v) = d and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x <> 0)")
    counts = {r["d"]: r["n"] for r in usable.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = _models(usable, counts, bucket, seed)
    blocks: dict[int, int] = {}
    if large := [d for d in counts if counts[d] > block(d)]:
        sizes = named.where(F.col("d").isin(large)).mapInArrow(_encoder(models, None, k), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
        most = F.create_map(*(F.lit(x) for d in large for x in (d, block(d))))[F.shiftright("g", 40).cast("int")]
        blocks = {r["g"]: -(-r["n"] // block(r["g"] >> 40)) for r in sizes.where(F.col("n") > most).collect()}
    buckets = named.where("d > 0").mapInArrow(_encoder(models, blocks, k), ROW)
    found = buckets.groupBy("g", "pair").applyInArrow(_searcher(models, blocks, k), "id long, near array<long>, cosine array<double>")
    return found.repartition("id").mapInArrow(_ranker(k), "vec_id long, rank int, neighbour long, cosine double")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b), smaller first: pairs of which at least one is among the other's nearest."""
    return near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()
