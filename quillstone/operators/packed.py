"""Packed inverted files: blocks of documents with their own postings, scored as arrays.

A block holds up to DOCS documents of one segment: its terms, the postings of each, and the documents' lengths, numbers,
values and categories. Queries come as chunks of weighted terms. A task adds up the scores of a chunk in a block, applies the queries' filters,
and keeps the best k of each query over all blocks that it meets, so only those travel on. Document frequencies
come from the blocks' own, so building an index shuffles nothing but those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.dense import first_k
from quillstone.operators.lexical import K1, B, bm25_idf
from quillstone.operators.ranking import top_k
from quillstone.session import spread, written

DOCS = 8192
#: Queries whose scores are held at a time in a task.
QUERIES = 256
#: Weighted terms of a chunk of queries, about; one chunk is sent to all tasks, more meet the blocks by a join.
ENTRIES = 200_000
FORMAT = 1
BLOCKS = "segment string, n int, ids binary, dl binary, value binary, category binary, categories array<string>, terms array<string>, df array<int>, rows binary, tf binary"
#: Columns of build()'s documents.
COLUMNS = ("number", "terms", "value", "category", "segment")


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes()])


def _block(batch: pa.Table) -> pa.RecordBatch:
    number, terms, value, category = (batch.column(c).combine_chunks() for c in COLUMNS[:4])
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(number)
    key, tf = np.unique(code * n + np.repeat(np.arange(n), lengths), return_counts=True)
    df = np.bincount(key // max(1, n), minlength=len(names))
    kinds = pa.compute.utf8_lower(category).fill_null("").dictionary_encode()
    columns = [
        pa.array([batch.column("segment")[0].as_py()], pa.string()),
        pa.array([n], pa.int32()),
        _bytes(number.to_numpy(zero_copy_only=False), "<i8"),
        _bytes(lengths, "<i4"),
        _bytes(value.to_numpy(zero_copy_only=False), "<f8"),
        _bytes(kinds.indices.to_numpy(zero_copy_only=False), "<i4"),
        pa.array([kinds.dictionary.to_pylist()], pa.list_(pa.string())),
        pa.array([names.to_pylist()], pa.list_(pa.string())),
        pa.array([df.tolist()], pa.list_(pa.int32())),
        _bytes(key % max(1, n), "<i4"),
        _bytes(tf, "<i4"),
    ]
    return pa.record_batch(columns, names=["segment", "n", "ids", "dl", "value", "category", "categories", "terms", "df", "rows", "tf"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # of one segment, fewer than DOCS rows

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield _block(pa.Table.from_batches(held))
            held.clear()

    for batch in batches:
        segment = batch.column(4).fill_null("").to_pylist()
        edges = [i for i in range(1, len(segment)) if segment[i] != segment[i - 1]] + [len(segment)]
        low = 0
        for high in edges:
            while low < high:
                if held and ((held[0].column(4)[0].as_py() or "") != segment[low] or sum(map(len, held)) >= DOCS):
                    yield from flush()
                end = min(high, low + DOCS - sum(map(len, held)))
                held.append(batch.slice(low, end - low))
                low = end
    yield from flush()


@dataclass
class PackedIndex:
    """blocks, terms(term, df), stats(n, avgdl): one row."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def build(docs: DataFrame, number: Column, terms: Column, value: Column | None = None, category: Column | None = None, segment: Column | None = None) -> PackedIndex:
        """The index of docs. number: a unique long that names a document and breaks ties, the lower one first; terms: an array of
        strings; value and category: for filters. Documents of one segment lie together; those with a null number are left out."""
        lone = lambda c, kind: (c if c is not None else F.lit(None)).cast(kind)
        named = spread(docs).select(number.cast("long").alias("number"), terms.alias("terms"), lone(value, "double").alias("value"), lone(category, "string").alias("category"), lone(segment, "string").alias("segment")).where("number is not null")
        if segment is not None:
            named = named.repartitionByRange("segment", F.xxhash64("number")).sortWithinPartitions("segment")
        index = PackedIndex._of(written(named.mapInArrow(_pack, BLOCKS)))
        return PackedIndex(index.blocks, written(index.terms), written(index.stats))

    @staticmethod
    def _of(blocks: DataFrame) -> PackedIndex:
        each = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
        # Lengths are summed by tasks, as bytes; documents without terms count in the average.
        total = F.arrow_udf(lambda dl: pa.array([int(np.frombuffer(x, "<i4").sum()) for x in dl.to_pylist()], pa.int64()), "long")
        sums = blocks.select("n", total("dl").alias("dl")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        stats = sums.select("n", F.coalesce(F.nullif(F.try_divide("dl", "n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
        return PackedIndex(blocks, each, stats)

    def save(self, path: str) -> None:
        """Blocks, a folder for each segment, and, last, a manifest; on any file system that Spark reads."""
        spark = self.blocks.sparkSession
        self.blocks.withColumn("part", F.coalesce("segment", F.lit("all"))).write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
        spark.createDataFrame([("packed", FORMAT, self.blocks.agg(F.sum("n")).first()[0] or 0)], "kind string, format int, count long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, count: int | None = None) -> PackedIndex:
        """A saved index; an error if it is of another kind or format, or of another count than asked for. Segments that no query
        needs aren't read."""
        found = spark.read.json(f"{path}/manifest").first()
        if found["kind"] != "packed" or found["format"] != FORMAT:
            raise ValueError("not a packed index of this format")
        if count is not None and count != found["count"]:
            raise ValueError(f"the index holds {found['count']} documents, not {count}")
        return PackedIndex._of(spark.read.schema(f"{BLOCKS}, part string").parquet(f"{path}/blocks"))

    def describe(self) -> DataFrame:
        """One row (kind, documents, blocks, bytes, terms): the size of the index."""
        size = sum((F.length(c) for c in ("ids", "dl", "value", "category", "rows", "tf")), F.lit(0))
        return self.blocks.agg(F.lit("packed").alias("kind"), F.sum("n").alias("documents"), F.count(F.lit(1)).alias("blocks"), F.sum(size).alias("bytes")).crossJoin(self.terms.agg(F.count(F.lit(1)).alias("terms")))


#: A term that more than one in this many documents of a block have is added up as a whole column.
COMMON = 16


def sums(terms: pa.Array, df: np.ndarray, at: np.ndarray, n: int, entries: pa.StructArray, weigh: Callable[[slice, int, float], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, scores of n documents, for each query one of its entries) of up to QUERIES queries at a time, in the order of their ids.

    terms, df, at: a block's terms, their numbers of documents, and the documents one after the other. entries(query_id, term, qtf, idf):
    what is asked for. weigh(postings, qtf, idf) gives the postings' weights, once for queries that share a common term.
    """
    ends = np.append(0, np.cumsum(df))
    qid, qtf, idf = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("query_id", "qtf", "idf"))
    term = pa.compute.index_in(entries.field("term"), terms).fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(qid, kind="stable")
    asked, first = np.unique(qid[order], return_index=True)
    bounds = np.append(first, len(order))
    columns: dict[tuple, np.ndarray] = {}
    for low in range(0, len(asked), QUERIES):
        part = asked[low : low + QUERIES]
        s = np.zeros((len(part), n))
        for j in range(len(part)):
            for e in order[bounds[low + j] : bounds[low + j + 1]]:
                if (t := term[e]) < 0:
                    continue
                of = slice(ends[t], ends[t + 1])
                if (of.stop - of.start) * COMMON < n:
                    s[j, at[of]] += weigh(of, qtf[e], idf[e])
                    continue
                if (key := (t, qtf[e], idf[e])) not in columns:
                    columns[key] = np.zeros(n)
                    columns[key][at[of]] = weigh(of, qtf[e], idf[e])
                s[j] += columns[key]
        yield part, s, order[first[low : low + QUERIES]]


def _scorer(k: int, how: str, decimals: int | None, k1: float, b: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        last: dict[tuple, np.ndarray] = {}  # the k-th best score of each query so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids, dl, value, kind, at, tf = (np.frombuffer(row[c].as_py(), t) for c, t in (("ids", "<i8"), ("dl", "<i4"), ("value", "<f8"), ("category", "<i4"), ("rows", "<i4"), ("tf", "<i4")))
                limits = {f["query_id"]: f for f in row["limits"].as_py()}
                scales = row["entries"].values.field("scale").to_numpy(zero_copy_only=False)
                length = k1 * (1 - b + b * dl / row["avgdl"].as_py())

                def weigh(of: slice, qtf: int, idf: float) -> np.ndarray:
                    if how == "overlap":
                        return np.minimum(tf[of], qtf) * idf
                    return idf * qtf * tf[of] * (k1 + 1) / np.maximum(tf[of] + length[at[of]], 1e-12)

                for part, s, entry in sums(row["terms"].values, row["df"].values.to_numpy(zero_copy_only=False), at, len(ids), row["entries"].values, weigh):
                    for j in range(len(part)) if limits else ():
                        limit = limits.get(part[j])
                        if limit:
                            if limit["max_value"] is not None:
                                s[j, ~(value <= limit["max_value"])] = 0
                            if limit["category"]:
                                s[j, ~np.array([limit["category"].lower() in c for c in row["categories"].as_py()], bool)[kind]] = 0
                            if limit["excluded"]:
                                s[j, np.isin(ids, limit["excluded"])] = 0
                    s /= scales[entry][:, None]
                    n = s.shape[1]
                    slack = 10.0**-decimals if decimals is not None else 0
                    key = (int(part[0]), len(part), int(part[-1]))
                    floor = last.get(key, np.full(len(part), -np.inf)) - slack
                    fresh = np.flatnonzero(floor == -np.inf)
                    if n > k and len(fresh):
                        floor[fresh] = np.partition(s[fresh], n - k, axis=1)[:, n - k] - slack
                    q, c = np.nonzero((s >= floor[:, None]) & (s > 0))
                    found = (part[q], ids[c], np.round(s[q, c], decimals) if decimals is not None else s[q, c])
                    if key in held:
                        found = tuple(np.concatenate(x) for x in zip(held[key], found))
                    keep = first_k(*found, k)
                    held[key] = tuple(x[keep] for x in found)
                    full, count = np.unique(held[key][0], return_counts=True)
                    last[key] = np.full(len(part), -np.inf)
                    last[key][np.searchsorted(part, full[count == k])] = held[key][2][np.cumsum(count)[count == k] - 1]
        for q, c, score in held.values():
            yield pa.record_batch([pa.array(q), pa.array(c), pa.array(score)], names=["query_id", "number", "score"])

    return run


def meet(blocks: DataFrame, packed: DataFrame, chunks: int, key: str, on: Sequence[str] = ()) -> DataFrame:
    """Blocks with the chunks of queries that they meet: one chunk goes to all tasks; of more, each pair of a part of the blocks (by their
    column key) and a chunk is a key of its own."""
    if chunks == 1:
        packed = packed.drop("chunk")
        return blocks.join(F.broadcast(packed), list(on)) if on else blocks.crossJoin(F.broadcast(packed))
    parts = max(1, blocks.rdd.getNumPartitions())
    blocks = blocks.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    packed = packed.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumn("chunk", F.col("chunk").cast("long"))
    return blocks.join(packed.hint("merge"), [*on, "deal", "chunk"])


def search(index: PackedIndex, wanted: DataFrame, k: int, how: str = "bm25", decimals: int | None = 4, limits: DataFrame | None = None, routes: DataFrame | None = None, scale: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, number, score): the best k documents of each query of wanted(query_id, term, qtf).

    how: 'bm25', or 'overlap' for the sum of idf x the smaller count. limits(query_id, max_value, category, excluded): filters,
    null or empty if off, that come before the cut. routes(query_id, segment): the segments that a query looks into, if not
    all; blocks of other segments aren't read. scale(query_id, scale): divides a query's scores. Ties in the score (rounded to decimals,
    if given) go to the lower number.
    """
    idf = bm25_idf(F.col("n"), F.col("df")) if how == "bm25" else F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    stats = F.broadcast(index.stats)
    terms = wanted.join(index.terms, "term").crossJoin(stats).select("query_id", "term", F.col("qtf").cast("long").alias("qtf"), idf.alias("idf"))
    terms = terms.join(scale, "query_id") if scale is not None else terms.withColumn("scale", F.lit(1.0))
    by = ["chunk"]
    if routes is not None:
        terms, by = terms.join(routes, "query_id"), ["segment", "chunk"]
    chunks = 1 + terms.count() // ENTRIES
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
    packed = terms.withColumn("chunk", chunk).groupBy(*by).agg(F.collect_list(F.struct("query_id", "term", "qtf", "idf", "scale")).alias("entries"))
    if limits is not None:
        each = limits.select("query_id", F.col("max_value").cast("double").alias("max_value"), "category", F.col("excluded").cast("array<long>").alias("excluded"), chunk)
        packed = packed.join(each.groupBy("chunk").agg(F.collect_list(F.struct("query_id", "max_value", "category", "excluded")).alias("limits")), "chunk")
    else:
        packed = packed.withColumn("limits", F.lit(None).cast("array<struct<query_id:long,max_value:double,category:string,excluded:array<long>>>"))
    packed = packed.withColumn("limits", F.coalesce("limits", F.array().cast("array<struct<query_id:long,max_value:double,category:string,excluded:array<long>>>")))
    blocks, on = index.blocks, []
    if routes is not None:
        on = ["part" if "part" in blocks.columns else "segment"]
        packed = packed.withColumnRenamed("segment", on[0])
    pairs = meet(blocks, packed, chunks, "ids", on)
    pairs = pairs.crossJoin(stats.select("avgdl")).select("ids", "dl", "value", "category", "categories", "terms", "df", "rows", "tf", "entries", "limits", "avgdl")
    found = pairs.mapInArrow(_scorer(k, how, decimals, k1, b), "query_id long, number long, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("number")], k).select("query_id", "rank", "number", "score")


def overlap_search(index: PackedIndex, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, number, score): the best k by shared terms, over the score of a query's best document (4 decimals)."""
    top = search(index, wanted, 1, "overlap", None).select("query_id", F.col("score").alias("scale"))
    return search(index, wanted, k, "overlap", 4, scale=top)
