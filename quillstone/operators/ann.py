"""Indexes of vectors that are built once, kept as tables, and searched: flat, inverted lists, product-quantised lists.

Vectors are normalised, so scores are cosines. An index is a table of blocks: up to BLOCK vectors of one list with their
ids, a numeric value for filters, and their elements or codes. Long lists are many blocks, which range partitioning
spreads over all tasks. Centroids and codebooks are fitted on a sample of bounded size. A folder with the tables and a
manifest, written last, is a saved index, on any file system that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.dense import BLOCK, HITS, SENT, Best, best, clean, exact_search, matrix, ranked, rerank_exact, unit
from quillstone.session import cut, written

#: Lists, at most, and sampled rows for each; the sample has at most their product.
LISTS, ROWS_A_LIST = 4096, 39
#: Queries that are compared with all vectors to find how many lists to probe.
ASKED = 256
FORMAT = 2
BLOCKS = "list int, n int, ids binary, value binary, x binary"


def list_count(n: int) -> int:
    """Inverted lists for n rows: about four times the root, with at least ROWS_A_LIST rows each."""
    return max(1, min(LISTS, n // ROWS_A_LIST, round(4 * n**0.5)))


def pq_segments(d: int) -> int:
    """The largest of 64, 32, … 1 that divides d."""
    return next(m for m in (64, 32, 16, 8, 4, 2, 1) if d % m == 0)


def k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = 15) -> np.ndarray:
    """Centroids of Lloyd's algorithm; empty ones are moved to random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.concatenate([(-2 * part @ centres.T + (centres**2).sum(1)).argmin(1) for part in np.array_split(x, max(1, len(x) // BLOCK))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


@dataclass
class Manifest:
    """What an index holds. A kind and a dimension are fixed when it is built; probes are chosen at each search."""

    kind: str
    dimension: int
    count: int
    lists: int
    segments: int = 0
    bits: int = 0
    format: int = FORMAT


@dataclass
class AnnIndex:
    """A built index; see build() and load()."""

    manifest: Manifest
    blocks: DataFrame
    centroids: np.ndarray
    books: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, kind: str = "ivf", value: Column | None = None, lists: int | None = None, segments: int | None = None, bits: int | None = None, seed: int = 7) -> AnnIndex:
        """The index of vectors(id, vector, …). kind: flat, ivf or ivfpq; value: a column of vectors that searches can bound.

        Rows with a null id or a null or empty vector are left out; vectors of several dimensions are an error, and so are
        fewer than 39 vectors for each centroid of a codebook. bits is chosen by the sample, at most 8, if it is null.
        """
        if kind not in ("flat", "ivf", "ivfpq"):
            raise ValueError(f"unknown kind of index: {kind}")
        named = vectors.select(F.col(vectors.columns[0]).alias("id"), F.col(vectors.columns[1]).alias("v"), (value if value is not None else F.lit(None)).cast("double").alias("value"))
        rows = named.where("id is not null and v is not null and size(v) > 0").select(F.col("id").cast("long"), F.col("v").cast("array<double>"), "value")
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if sizes["low"] != sizes["high"]:
            raise ValueError("an index holds vectors of one dimension")
        n, d = sizes["n"], sizes["low"] or 0
        wanted = 1 if kind == "flat" else min(lists or list_count(n), max(1, n))
        sample = _sample(rows, n, max(20_000, ROWS_A_LIST * wanted))
        centroids = unit(k_means(sample, wanted, seed)) if wanted > 1 else np.zeros((1, d))
        books, m = np.zeros((0, 0, 0)), 0
        if kind == "ivfpq":
            rest = sample - centroids[(sample @ centroids.T).argmax(axis=1)]
            bits = bits or max(1, min(8, int(np.log2(max(2, len(sample) / ROWS_A_LIST)))))
            if len(sample) < ROWS_A_LIST << bits:
                raise ValueError(f"{bits} bits need {ROWS_A_LIST << bits} vectors")
            m = segments if segments and d % segments == 0 else pq_segments(d)
            books = np.stack([k_means(part, 1 << bits, seed) for part in np.split(rest, m, axis=1)])
        placed = rows.mapInArrow(_placer(centroids), "id long, v array<double>, value double, list int")
        # Ranges of (list, hash) are of like size, so a list that holds a third of all rows lies in many partitions.
        ordered = placed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list") if wanted > 1 else placed
        blocks = written(ordered.mapInArrow(_packer(centroids, books), BLOCKS))
        return AnnIndex(Manifest(kind, d, n, wanted, m, bits or 0), blocks, centroids, books)

    def save(self, path: str) -> None:
        """Tables and, last, the manifest."""
        spark = self.blocks.sparkSession
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        tables = {"centroids": self.centroids} | ({"books": self.books.reshape(-1, self.books.shape[-1])} if self.books.size else {})
        for name, x in tables.items():
            spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "no int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([tuple(asdict(self.manifest).values())], list(asdict(self.manifest))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str | None = None, dimension: int | None = None, count: int | None = None) -> AnnIndex:
        """A saved index; an error if it isn't of the kind, dimension or count that is asked for, or its tables don't agree with its manifest."""
        row = spark.read.json(f"{path}/manifest").first().asDict()
        found = Manifest(**{name: row[name] for name in Manifest.__dataclass_fields__})
        if found.format != FORMAT:
            raise ValueError(f"format {found.format} of an index isn't known")
        for name, asked in (("kind", kind), ("dimension", dimension), ("count", count)):
            if asked is not None and asked != getattr(found, name):
                raise ValueError(f"the index has {name} {getattr(found, name)}, not {asked}")
        blocks = spark.read.parquet(f"{path}/blocks")
        if (held := blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) != found.count:
            raise ValueError(f"the index holds {held} vectors, its manifest says {found.count}")
        table = lambda name: np.array([r["v"] for r in spark.read.parquet(f"{path}/{name}").orderBy("no").collect()], np.float64)
        books = table("books").reshape(found.segments, 1 << found.bits, -1) if found.segments else np.zeros((0, 0, 0))
        return AnnIndex(found, blocks, table("centroids").reshape(found.lists, -1), books)

    def describe(self) -> DataFrame:
        """One row: the manifest, and how many bytes the blocks take, in all and for each vector."""
        sizes = self.blocks.agg(F.coalesce(F.sum(F.length("x") + F.length("ids") + F.length("value")), F.lit(0)).alias("bytes"))
        return sizes.select(*(F.lit(v).alias(k) for k, v in asdict(self.manifest).items()), "bytes", F.try_divide(F.col("bytes"), F.lit(self.manifest.count)).alias("bytes_per_vector"))

    def list_sizes(self) -> np.ndarray:
        """Vectors in each list."""
        out = np.zeros(self.manifest.lists, np.int64)
        for r in self.blocks.groupBy("list").agg(F.sum("n").alias("n")).collect():  # at most LISTS rows
            out[r["list"]] = r["n"]
        return out

    def hits(self, queries: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """(query_id, vec_id, score): the best k of each of queries(id, vector, max_value) in its lists low to high, by nearness."""
        if not self.manifest.dimension:  # an index of nothing
            return queries.sparkSession.createDataFrame([], HITS)
        asked = queries.toDF("id", "v", "most").where("id is not null and v is not null and size(v) > 0").select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("most").cast("double"))
        probed = asked.mapInArrow(_prober(self.centroids, low, high), "list int, qids binary, qx binary, most binary")
        # Queries in all the lists they probe are sent to all tasks if they are few; a plan can't tell by itself.
        size = asked.count() * (min(high, self.manifest.lists) - low) * 8 * self.manifest.dimension
        pairs = self.blocks.join(F.broadcast(probed) if size <= SENT else probed.hint("merge"), "list").select("ids", "value", "x", "list", "qids", "qx", "most")
        return pairs.mapInArrow(_list_scorer(k, self.manifest.dimension, self.centroids, self.books), HITS)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 32, max_value: Column | None = None, candidates: int = 500, vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): the best k in the probes nearest lists of each of queries(id, vector), its own id left out.

        max_value: a column of queries; only vectors with a value up to it count, and the filter comes before the cut. A product-quantised
        index takes the best candidates by its codes and reranks them by their vectors(id, vector).
        """
        asked = _asked(queries, max_value)
        if self.manifest.kind == "ivfpq":
            if vectors is None:
                raise ValueError("a product-quantised index reranks by vectors")
            coarse = ranked(self.hits(asked, candidates, 0, probes), candidates)
            return rerank_exact(coarse, vectors, queries.select(*queries.columns[:2]), k)
        return ranked(self.hits(asked, k, 0, probes), k)


def _asked(queries: DataFrame, max_value: Column | None) -> DataFrame:
    return queries.select(F.col(queries.columns[0]).alias("id"), F.col(queries.columns[1]).alias("v"), (max_value if max_value is not None else F.lit(None)).cast("double").alias("most"))


def _sample(rows: DataFrame, n: int, size: int) -> np.ndarray:
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, size / max(1, n)) * (1 << 20)) + 1).orderBy("id")
    return unit(np.array([r["v"] for r in chosen.select("v").collect()], np.float64)) if n else np.zeros((0, 0))


def _placer(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(matrix(batch.column(1))) @ centroids.T).argmax(axis=1) if len(batch) else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "value", "list"])

    return run


def _packer(centroids: np.ndarray, books: np.ndarray):
    def block(of: int, ids: np.ndarray, value: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        x = unit(x)
        if len(books):
            parts = np.split(x - centroids[of], len(books), axis=1)
            kept = np.stack([(-2 * p @ b.T + (b**2).sum(1)).argmin(1) for p, b in zip(parts, books)], axis=1).astype(np.uint8)
        else:
            kept = x
        columns = [pa.array([of], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([y.tobytes()]) for y in (ids.astype("<i8"), value.astype("<f8"), kept))]
        return pa.record_batch(columns, names=["list", "n", "ids", "value", "x"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of one list, fewer than BLOCK rows

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield block(held[0][0], *(np.concatenate(c) for c in list(zip(*held))[1:]))
                held.clear()

        for batch in batches:
            ids, value, lists = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            x = matrix(batch.column(1)) if len(batch) else None
            edges = np.append(np.flatnonzero(np.diff(lists)) + 1, len(lists))
            low = 0
            for high in edges.tolist():
                while low < high:
                    if held and (held[0][0] != lists[low] or sum(len(h[1]) for h in held) >= BLOCK):
                        yield from flush()
                    end = min(high, low + BLOCK - sum(len(h[1]) for h in held))
                    held.append((int(lists[low]), ids[low:end], value[low:end].astype(np.float64), x[low:end]))
                    low = end
        yield from flush()

    return run


def _prober(centroids: np.ndarray, low: int, high: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            ids, x, most = batch.column(0).to_numpy(zero_copy_only=False), unit(matrix(batch.column(1))), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, low:high]
            order = np.argsort(near, axis=None, kind="stable")
            lists, query = near.ravel()[order], order // max(1, near.shape[1])
            ends = np.append(np.flatnonzero(np.diff(lists)) + 1, len(lists)) if len(lists) else np.zeros(0, np.int64)
            cells = [(lists[i], query[i:j]) for i, j in zip(np.append(0, ends[:-1]), ends)] if len(lists) else []
            yield pa.record_batch([pa.array([int(c) for c, _ in cells], pa.int32()), *(pa.array([y[at].tobytes() for _, at in cells], pa.binary()) for y in (ids.astype("<i8"), x, most))], names=["list", "qids", "qx", "most"])

    return run


def _list_scorer(k: int, d: int, centroids: np.ndarray, books: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(k)
        for batch in batches:
            for ids, value, x, of, qids, qx, most in zip(*(batch.column(i).to_pylist() for i in range(7))):
                rids, qn, q = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8"), np.frombuffer(qx).reshape(-1, d)
                if len(books):  # the centroid's part, and a look-up for each segment of the residual
                    codes = np.frombuffer(x, np.uint8).reshape(-1, len(books))
                    s = (q @ centroids[of])[:, None] + sum((p @ b.T)[:, codes[:, j]] for j, (p, b) in enumerate(zip(np.split(q, len(books), axis=1), books)))
                else:
                    s = q @ np.frombuffer(x).reshape(-1, d).T
                bound = np.frombuffer(most)
                if not np.isnan(bound).all():
                    s[~(np.isnan(bound)[:, None] | (np.frombuffer(value)[None, :] <= bound[:, None]))] = -np.inf
                row, at, score = best(s, qn, rids, k, 6 if len(books) else 4)
                found.add(qids, qn[row], rids[at], score)
        yield from found.rows()

    return run


def union_best(rounds: list[DataFrame]) -> DataFrame:
    """(query_id, vec_id, score): the union of several rounds of hits; an item that several found counts once, with its best score."""
    return reduce(DataFrame.unionByName, rounds).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def filtered_search(index: AnnIndex, queries: DataFrame, k: int, max_value: Column, vectors: DataFrame | None = None, probes: int = 4, rounds: int = 6, grow: int = 4) -> tuple[DataFrame, DataFrame]:
    """(hits, statistics) of a search whose filter may leave a query short of k hits: such queries probe further lists, grow
    times as many in each round; those still short after the last round, with lists left unprobed, are searched exactly in vectors(id, vector, value).

    hits: (query_id, rank, vec_id, score). statistics: (query_id, rounds, probes, examined, matched, fallback, exhausted) of
    each query; fallback is 'exact' or 'none', exhausted says that fewer than k vectors pass the filter. The number of
    rounds is bounded, and only counts of queries come to the driver.
    """
    asked = cut(_asked(queries, max_value))
    lists, sizes = index.manifest.lists, index.list_sizes()
    searched: list[DataFrame] = []
    stats: list[DataFrame] = []
    low, high, short = 0, min(probes, lists), asked
    found = None
    for turn in range(1, rounds + 1):
        searched.append(index.hits(short, k, low, high))
        found = cut(ranked(union_best(searched), k))
        searched = [found.select("query_id", "vec_id", "score")]
        counted = short.select(F.col("id").alias("query_id")).join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched")), "query_id", "left").fillna(0, ["matched"])
        done = (F.col("matched") >= k) | F.lit(high >= lists)
        counted = cut(counted.withColumns({"rounds": F.lit(turn), "probes": F.lit(high), "open": ~done}))
        stats.append(counted)
        short = short.join(counted.where("open").select(F.col("query_id").alias("id")), "id", "left_semi").select("id", "v", "most")
        if high >= lists or turn == rounds or not counted.where("open").limit(1).count():
            break
        low, high = high, min(lists, high * grow)
    last = stats[-1].where("open").select("query_id") if stats else None
    whole = reduce(DataFrame.unionByName, [s.where(~F.col("open")) for s in stats] + [stats[-1].where("open")])
    if vectors is not None and last is not None:
        exact = cut(_exact_filtered(index.manifest, vectors, short, k))
        found = found.join(last, "query_id", "left_anti").unionByName(exact)
        again = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("again"))
        whole = whole.join(again, "query_id", "left").withColumn("matched", F.when(F.col("open"), F.coalesce("again", F.lit(0))).otherwise(F.col("matched"))).drop("again")
    asked_for = whole.join(asked.select(F.col("id").alias("query_id"), "v"), "query_id").select("query_id", F.col("v").cast("array<double>"), "rounds", "probes", "matched", "open")
    told = asked_for.mapInArrow(_examiner(index.centroids, sizes), "query_id long, rounds int, probes int, examined long, matched long, open boolean")
    fallback = F.when(F.col("open") & F.lit(vectors is not None), "exact").otherwise("none").alias("fallback")
    return found, told.select("query_id", "rounds", "probes", "examined", "matched", fallback, (F.col("matched") < k).alias("exhausted"))


def _examiner(centroids: np.ndarray, sizes: np.ndarray):
    """Adds how many vectors lie in the lists that a query probes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            near = np.argsort(-(unit(matrix(batch.column(1))) @ centroids.T), axis=1, kind="stable")
            upto = np.cumsum(sizes[near], axis=1)[np.arange(len(batch)), batch.column(3).to_numpy(zero_copy_only=False) - 1]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(upto), batch.column(4), batch.column(5)], names=["query_id", "rounds", "probes", "examined", "matched", "open"])

    return run


def _exact_filtered(manifest: Manifest, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    flat = AnnIndex(Manifest("flat", manifest.dimension, 0, 1), _flat_blocks(vectors), np.zeros((1, manifest.dimension)), np.zeros((0, 0, 0)))
    return ranked(flat.hits(queries, k, 0, 1), k)


def _flat_blocks(vectors: DataFrame) -> DataFrame:
    a, b, c = vectors.columns[:3]
    rows = vectors.select(F.col(a).cast("long").alias("id"), F.col(b).cast("array<double>").alias("v"), F.col(c).cast("double").alias("value"), F.lit(0).alias("list")).where("id is not null and v is not null and size(v) > 0")
    return rows.mapInArrow(_packer(np.zeros((1, 0)), np.zeros((0, 0, 0))), BLOCKS)


def enough_probes(index: AnnIndex, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, seed: int = 7) -> int:
    """Probes with which ASKED of the queries find the share recall of their true top k; their truth is exact, over all vectors(id, vector)."""
    centroids = index.centroids
    chosen = clean(queries).orderBy(F.xxhash64("id", F.lit(seed))).limit(ASKED)
    truth = exact_search(vectors, chosen, k, "cosine").select("query_id", "vec_id")
    vector = lambda key: clean(vectors).toDF(key, "__v")
    named = truth.join(vector("vec_id"), "vec_id").join(chosen.toDF("query_id", "__q"), "query_id").select("__q", "__v").select(F.col("__q").cast("array<double>"), F.col("__v").cast("array<double>"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q, v = (unit(matrix(batch.column(i))) for i in (0, 1))
                place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
                yield pa.record_batch([pa.array(place[np.arange(len(q)), (v @ centroids.T).argmax(axis=1)] + 1)], names=["probe"])

    needed = sorted(r["probe"] for r in named.mapInArrow(run, "probe long").collect())  # ASKED x k numbers at most
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, lists: int | None = None, seed: int = 7, recall: float = 0.95) -> DataFrame:
    """Builds an index of inverted lists and searches it; if probes is null, with as many as give a sample of the queries this recall."""
    index = AnnIndex.build(vectors, "ivf", lists=lists, seed=seed)
    return index.search(queries, k, enough_probes(index, vectors, queries, k, recall, seed) if probes is None else probes)


def pq_search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None, segments: int = 32, candidates: int = 200, probes: int | None = None, seed: int = 7) -> DataFrame:
    """Builds an index of product-quantised lists and searches it; probes as in ivf_search()."""
    index = AnnIndex.build(vectors, "ivfpq", segments=segments, bits=bits, seed=seed)
    return index.search(queries, k, enough_probes(index, vectors, queries, k, 0.98, seed) if probes is None else probes, candidates=candidates, vectors=vectors)
