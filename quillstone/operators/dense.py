"""Vector retrieval: exact search in blocks, exact reranking, and random-projection hashing; ann.py has indexes to keep.

Vectors are packed into blocks of a few thousand rows, one binary value each, so that scores are matrix products and a
task's memory doesn't depend on the table's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.ranking import top_k
from quillstone.session import spread

BLOCK = 4096
#: A k that cuts nothing off.
ALL = (1 << 31) - 1
#: Bytes of packed queries that are sent to all tasks at once, at most.
SENT = 64 << 20
#: Rows, about, that meet a query in one bucket of random projections.
BUCKET = 256


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clean(vectors: DataFrame) -> DataFrame:
    """(id, v) without null ids and null or empty vectors."""
    return vectors.toDF("id", "v").where("id is not null and v is not null and size(v) > 0").withColumn("id", F.col("id").cast("long"))


def _packer(size: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                of = np.flatnonzero(lengths == d)
                for i in range(0, len(of), size):
                    part = batch.take(pa.array(of[i : i + size]))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                    ids, groups = (part.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in (0, 2))
                    yield pa.record_batch([pa.array([ids]), pa.array([x.tobytes()]), pa.array([int(d)], pa.int32()), pa.array([groups])], names=["ids", "x", "d", "groups"])

    return run


def kind_of(vectors: DataFrame) -> str:
    """How packed elements are stored: as they are in the table."""
    element = vectors.schema[1].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def packed(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks (ids, x, d, groups) of rows (id long, vector[, group]) with vectors of one length d; null and empty vectors are left out."""
    kind = kind_of(vectors)
    group = F.xxhash64(vectors.columns[2]) if len(vectors.columns) > 2 else F.lit(0).cast("long")
    rows = spread(vectors).select(F.col(vectors.columns[0]).cast("long").alias("id"), F.col(vectors.columns[1]).alias("v"), group.alias("g")).where("id is not null and v is not null and size(v) > 0")
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.mapInArrow(_packer(size, kind), "ids binary, x binary, d int, groups binary")


def best(s: np.ndarray, qids: np.ndarray, rids: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of each row's k best scores, its own id left out; ties after rounding go to the lower id."""
    own = np.argsort(rids, kind="stable")
    at = own[np.minimum(np.searchsorted(rids, qids, sorter=own), len(rids) - 1)]
    same = np.flatnonzero(rids[at] == qids)
    s[same, at[same]] = -np.inf
    n = s.shape[1]
    floor = np.partition(s, n - k, axis=1)[:, n - k] - 10.0**-decimals if n > k else np.full(len(s), -np.inf)
    row, at = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    score = np.round(s[row, at], decimals)
    keep = first_k(row, rids[at], score, k)
    return row[keep], at[keep], score[keep]


def first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best scores of each row are, in order; ties go to the lower id."""
    order = np.lexsort((ids, -score, row))
    start = np.flatnonzero(np.append(True, np.diff(row[order]) != 0)) if len(row) else np.zeros(0, np.int64)
    return order[np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < k]


class Best:
    """The best k of each query so far, over the blocks that a task meets."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, key: bytes, qids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if key in self.held:
            q, i, s = (np.concatenate(x) for x in zip(self.held[key], (qids, ids, score)))
            keep = first_k(q, i, s, self.k)
            qids, ids, score = q[keep], i[keep], s[keep]
        self.held[key] = (qids, ids, score)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, i, s in self.held.values():
            yield pa.record_batch([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


def _scorer(k: int, metric: str, decimals: int, kinds: tuple[str, str], among: str | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(k)
        for batch in batches:
            for qi, qx, ri, rx, d, *groups in zip(*(c.to_pylist() for c in batch.columns)):
                q, r = (np.frombuffer(b, kind).reshape(-1, d).astype(np.float64) for b, kind in zip((qx, rx), kinds))
                qids, rids = np.frombuffer(qi, "<i8"), np.frombuffer(ri, "<i8")
                if metric == "cosine":
                    q, r = unit(q), unit(r)
                s = -((q**2).sum(1)[:, None] - 2 * q @ r.T + (r**2).sum(1)) if metric == "l2" else q @ r.T
                if among:
                    qg, rg = (np.frombuffer(g, "<i8") for g in groups)
                    s[(qg[:, None] == rg[None, :]) != (among == "same")] = -np.inf
                row, at, score = best(s, qids, rids, k, decimals)
                found.add(qi, qids[row], rids[at], score)
        yield from found.rows()

    return run


HITS = "query_id long, vec_id long, score double"


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", decimals: int = 4, among: str | None = None, sent: int = SENT) -> DataFrame:
    """(query_id, rank, vec_id, score): the top k of vectors(id, vector) for all queries(id, vector), a row's own id left out.

    Only vectors of the query's dimension are compared. Scores are rounded before they are ranked; ties go to the lower
    id. metric: ip (inner product), cosine, or l2 (minus squared distance). among: 'same' or 'other', to compare only
    rows whose third column, a group, is or isn't the query's.

    It compares a stated query set with all rows, block by block. Queries of up to SENT bytes go to all tasks; more are
    dealt, like the vectors, into parts of about that size, and each pair of parts is a key of its own.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    q, r = packed(queries).toDF("qi", "qx", "d", "qg"), packed(vectors).toDF("ri", "rx", "d", "rg")
    parts = lambda rows: 1 + (8 * (rows.agg(F.sum(F.size(rows.columns[1]))).first()[0] or 0)) // sent
    if (n := parts(queries)) == 1:
        pairs = r.join(F.broadcast(q), "d")
    else:
        m = parts(vectors)
        deal = lambda blocks, ids, own, count, other, others: blocks.withColumn(own, F.pmod(F.xxhash64(ids), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        pairs = deal(r, "ri", "x", m, "y", n).join(deal(q, "qi", "y", n, "x", m), ["d", "x", "y"])
    found = pairs.select("qi", "qx", "ri", "rx", "d", "qg", "rg").mapInArrow(_scorer(k, metric, decimals, (kind_of(queries), kind_of(vectors)), among), HITS)
    return ranked(found, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of hits(query_id, vec_id, score): the k best, ties to the lower id."""
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def rerank_exact(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): candidates(query_id, vec_id, …) ranked anew by the cosine of their vectors."""
    from quillstone.functions.vectors import cosine

    named = candidates.select("query_id", "vec_id").join(vectors.toDF("vec_id", "v"), "vec_id").join(queries.toDF("query_id", "q"), "query_id")
    scored = named.where("query_id <> vec_id").select("query_id", "vec_id", F.round(cosine(F.col("v"), F.col("q")), 4).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 10, bits: int | None = None, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """The best k by cosine among the vectors that share a bucket with a query in at least one of the tables.

    A bucket is a pattern of signs of random projections; a query also looks into those whose pattern differs in one sign.
    A table has as many bits as keep a bucket near bucket rows, if bits is null. Rows of a bucket are packed into blocks and scored where
    they lie, so a large bucket is many blocks, and only the best of each task travel on.
    """
    rows, asked = clean(spread(vectors)), clean(queries)
    kinds = kind_of(queries), kind_of(vectors)
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    of = {d: bits if bits is not None else max(0, round(np.log2(n / bucket))) for d, n in sizes.items()}
    planes = {d: np.random.default_rng([seed, d]).standard_normal((d, tables * b)) for d, b in of.items()}

    def coder(kind: str, near: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths):
                    if int(d) not in of:
                        continue
                    b = of[int(d)]
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    ids, x = part.column(0).to_numpy(zero_copy_only=False).astype("<i8"), matrix(part.column(1))
                    codes = ((x @ planes[int(d)] > 0).reshape(-1, tables, b) @ (1 << np.arange(b))).astype(np.int64)
                    raw = x.astype(kind)
                    for t in range(tables):
                        for flip in (0, *(1 << np.arange(b))) if near else (0,):
                            code = codes[:, t] ^ int(flip)
                            order = np.argsort(code, kind="stable")
                            ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order))
                            cells = [(code[order[i]], order[i:j]) for i, j in zip(np.append(0, ends[:-1]), ends)]
                            yield pa.record_batch([pa.array([int(d)] * len(cells), pa.int32()), pa.array([(t << 48) | int(c) for c, _ in cells], pa.int64()), pa.array([ids[at].tobytes() for _, at in cells]), pa.array([raw[at].tobytes() for _, at in cells])], names=["d", "cell", "ids", "x"])

        return run

    blocks = lambda of, kind, near, *names: of.withColumn("v", F.col("v").cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(coder(kind, near), "d int, cell long, ids binary, x binary").toDF("d", "cell", *names)
    most = max((tables * (b + 1) * 8 * d for d, b in of.items()), default=0)
    probed = blocks(asked, kinds[0], True, "qi", "qx")
    pairs = blocks(rows, kinds[1], False, "ri", "rx").join(F.broadcast(probed) if asked.count() * most <= SENT else probed.hint("merge"), ["d", "cell"])
    found = pairs.select("qi", "qx", "ri", "rx", "d").mapInArrow(_scorer(k, "cosine", 4, kinds), HITS)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
