"""The TF-IDF baseline of all documents, as arrays: the share of a query's tokens that a document has, weighted by idf.

Scores are shares of the query's best document, over all documents and before any filter. Blocks hold up to DOCS documents with
their postings, so a task adds up a chunk of queries in a block, and a score is a row only where the result has it: best scores are one row for each query and
task, and those of given pairs are added up from the pairs' documents alone. Rows of one id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.packed import DOCS, ENTRIES, meet, sums
from quillstone.session import written

BLOCKS = "n int, names array<string>, terms array<string>, df array<int>, rows binary, tf binary"
#: Rows of a batch of results, about.
ROWS = 100_000


def share(s: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Scores over the best (4 decimals, halves up)."""
    return np.floor(s / best * 1e4 + 0.5) / 1e4


def documents(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, text, …) of docs(doc_id, text, …): one row for an id, in partitions that are small enough to work on."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return docs.repartition(parts, "doc_id").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"), *keep)


def postings(terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, df, documents, counts) of a column of term lists."""
    n, lengths = len(terms), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    return coded.dictionary, np.bincount(key // n, minlength=len(coded.dictionary)), key % n, tf


def packer(more: Callable[[pa.RecordBatch], dict[str, pa.Array]] = lambda rows: {}) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that packs rows (doc_id, terms, …) into blocks; more gives a block's further columns."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        names, df, at, tf = postings(rows.column(1))
        lone = [pa.array([x.to_pylist()], pa.list_(pa.string())) for x in (rows.column(0), names)]
        raw = [pa.array([x.astype("<i4").tobytes()]) for x in (at, tf)]
        columns = [pa.array([rows.num_rows], pa.int32()), *lone, pa.array([df.tolist()], pa.list_(pa.int32())), *raw]
        return pa.record_batch([*columns, *(added := more(rows)).values()], names=["n", "names", "terms", "df", "rows", "tf", *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, DOCS - sum(map(len, held)))
                held.append(part)
                batch = batch.slice(len(part))
                if sum(map(len, held)) == DOCS:
                    yield block(held)
                    held.clear()
        if held:
            yield block(held)

    return run


def _asked(run: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives run(block, query ids, scores, which entries) what each block holds."""

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                at, tf = (np.frombuffer(row[c].as_py(), "<i4") for c in ("rows", "tf"))
                for part, s, entry in sums(row["terms"].values, row["df"].values.to_numpy(zero_copy_only=False), at, row["n"].as_py(), row["entries"].values, lambda of, qtf, idf: np.minimum(tf[of], qtf) * idf):
                    yield from run(row, part, s, entry)

    return scored


def _best(row: dict, part: np.ndarray, s: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
    most = s.max(axis=1)
    yield pa.record_batch([pa.array(part[most > 0]), pa.array(most[most > 0])], names=["query_id", "best"])


def _best_and_pairs(row: dict, part: np.ndarray, s: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The best sums, with a null doc_id, and those of the pairs that are in the block."""
    for best in _best(row, part, s, entry):
        yield pa.record_batch([best.column(0), pa.nulls(len(best), pa.string()), best.column(1)], names=["query_id", "doc_id", "s"])
    pairs = row["pairs"].values
    query = pairs.field("query_id").to_numpy(zero_copy_only=False)
    at = np.flatnonzero((query >= part[0]) & (query <= part[-1]))
    q = np.searchsorted(part, query[at])
    at, q = at[part[q] == query[at]], q[part[q] == query[at]]
    named = pairs.field("doc_id").take(pa.array(at))
    c = pa.compute.index_in(named, row["names"].values).fill_null(-1).to_numpy(zero_copy_only=False)
    here = np.flatnonzero(c >= 0)
    here = here[s[q[here], c[here]] > 0]
    yield pa.record_batch([pa.array(part[q[here]]), named.take(pa.array(here)), pa.array(s[q[here], c[here]])], names=["query_id", "doc_id", "s"])


def _all(row: dict, part: np.ndarray, s: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
    best = row["entries"].values.field("best").to_numpy(zero_copy_only=False)[entry]
    names = row["names"].values
    step = max(1, ROWS // max(1, s.shape[1]))
    for low in range(0, len(part), step):
        q, c = np.nonzero(s[low : low + step])
        score = share(s[low + q, c], best[low + q])
        yield pa.record_batch([pa.array(part[low + q]), names.take(pa.array(c)), pa.array(score)], names=["query_id", "doc_id", "score"])


@dataclass
class Baseline:
    """blocks, terms(term, df), and n, the number of catalog rows."""

    blocks: DataFrame
    terms: DataFrame
    n: int

    @staticmethod
    def build(docs: DataFrame, terms: Callable[[Column], Column]) -> Baseline:
        """Of docs(doc_id, text)."""
        return Baseline.of(documents(docs).select("doc_id", terms(F.col("text")).alias("terms")).mapInArrow(packer(), BLOCKS), docs)

    @staticmethod
    def of(blocks: DataFrame, docs: DataFrame) -> Baseline:
        """Of blocks that packer() made of docs."""
        blocks = written(blocks)
        df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
        return Baseline(blocks, written(df), docs.count())

    def weighted(self, wanted: DataFrame) -> DataFrame:
        """(query_id, term, qtf, idf) of wanted(query_id, term, qtf)."""
        idf = F.log((F.lit(self.n) + 1) / (F.col("df") + 1)) + 1
        return wanted.join(self.terms, "term").select("query_id", "term", F.col("qtf").cast("long").alias("qtf"), idf.alias("idf"))

    def _run(self, entries: DataFrame, run: Callable, schema: str, pairs: DataFrame | None = None) -> DataFrame:
        # A pair is about a quarter of an entry's work.
        chunks = 1 + (entries.count() + (pairs.count() // 4 if pairs is not None else 0)) // ENTRIES
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
        packed = entries.groupBy(chunk).agg(F.collect_list(F.struct(*entries.columns)).alias("entries"))
        if pairs is not None:
            packed = packed.join(pairs.groupBy(chunk).agg(F.collect_list(F.struct("query_id", "doc_id")).alias("pairs")), "chunk")
        blocks = self.blocks.select("n", "names", "terms", "df", "rows", "tf")
        met = meet(blocks, packed, chunks, "rows")
        return met.select(*blocks.columns, *[c for c in packed.columns if c != "chunk"]).mapInArrow(_asked(run), schema)

    def best(self, weighted: DataFrame) -> DataFrame:
        """(query_id, best): the sum of each query's best document."""
        return written(self._run(weighted, _best, "query_id long, best double").groupBy("query_id").agg(F.max("best").alias("best")))

    def scores(self, wanted: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents that share a term with a query. Nothing is shuffled by documents."""
        weighted = written(self.weighted(wanted))
        return self._run(weighted.join(self.best(weighted), "query_id"), _all, "query_id long, doc_id string, score double")

    def scores_of(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, doc_id, table_score): scores() of pairs(query_id, doc_id) alone."""
        found = written(self._run(written(self.weighted(wanted)), _best_and_pairs, "query_id long, doc_id string, s double", pairs))
        best = found.where("doc_id is null").groupBy("query_id").agg(F.max("s").alias("best"))
        return found.where("doc_id is not null").join(best, "query_id").select("query_id", "doc_id", F.round(F.col("s") / F.col("best"), 4).alias("table_score"))
