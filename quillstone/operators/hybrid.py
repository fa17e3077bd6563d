"""Weighted text and image search over blocks of documents: fusion.hybrid() as arrays, without a table of scores.

A block of the baseline also holds its documents' catalog rows and pictures' vectors. A task fuses both scores of a query over a block,
filters, and keeps the best k of each query over all blocks that it meets; only those travel on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.baseline import BLOCKS, Baseline, documents, packer, share
from quillstone.operators.dense import unit
from quillstone.operators.fusion import first_hybrid
from quillstone.operators.packed import ENTRIES, meet, sums
from quillstone.session import written

HITS = "query_id long, doc_id string, row_id long, rating double, max_value double, score double, text_score double, image_score double"


def _more(rows: pa.RecordBatch) -> dict[str, pa.Array]:
    """Catalog rows: the document of each, and its columns. Pictures: the document of each, its vector's length, and the vectors."""
    items, v = rows.column(2), rows.column(3)
    lengths = items.value_lengths().to_numpy(zero_copy_only=False)
    one = lambda x: pa.array([np.ascontiguousarray(x).tobytes()])
    lone = lambda c, kind: pa.array([items.flatten().field(c).to_pylist()], pa.list_(kind))
    there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    d = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[there]
    return {"of": one(np.repeat(np.arange(len(rows)), lengths).astype("<i4")), "row_id": lone("row_id", pa.int64()), "rating": lone("rating", pa.float64()), "value": lone("value", pa.float64()), "category": lone("category", pa.string()), "pictured": one(there.astype("<i4")), "d": one(d.astype("<i4")), "x": one(v.flatten().to_numpy(zero_copy_only=False))}


class _Block:
    """A block, and the hits of a query in it."""

    def __init__(self, row: dict, kind: str, k: int, weight: float) -> None:
        self.k, self.weight, self.n = k, weight, row["n"].as_py()
        self.names, self.row_id, self.rating = (row[c].values for c in ("names", "row_id", "rating"))
        self.of, self.pictured, d = (np.frombuffer(row[c].as_py(), "<i4") for c in ("of", "pictured", "d"))
        self.value = row["value"].values.to_numpy(zero_copy_only=False)
        self.category = row["category"].values
        # Order: null last, and no number first, as Spark has it.
        rating = self.rating.to_numpy(zero_copy_only=False)
        self.rated = np.where(self.rating.is_null().to_numpy(zero_copy_only=False), -np.inf, np.where(np.isnan(rating), np.inf, rating))
        self.last = self.row_id.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        x, start = np.frombuffer(row["x"].as_py(), kind), np.append(0, np.cumsum(d))
        self.pictures = {}
        for length in np.unique(d):
            at = np.flatnonzero(d == length)
            self.pictures[int(length)] = self.pictured[at], unit(x[start[at][:, None] + np.arange(length)].astype(np.float64))
        self.fitting: dict[tuple, np.ndarray] = {}

    def fits(self, q: dict) -> np.ndarray:
        key = q["max_value"], (q["category"] or "").lower()
        if key not in self.fitting:
            fits = np.ones(len(self.of), bool) if key[0] is None else self.value <= key[0]
            if key[1]:
                fits = fits & np.array([key[1] in (c or "").lower() for c in self.category.to_pylist()], bool)
            self.fitting[key] = fits
        fits = self.fitting[key]
        if q["excluded"]:
            fits = fits & ~pa.compute.is_in(self.names, pa.array(q["excluded"], pa.string())).to_numpy(zero_copy_only=False)[self.of]
        return fits

    def hits(self, q: dict, sums: np.ndarray | None, best: float, floor: float) -> tuple[np.ndarray, ...]:
        """(row, score, text score, image score) of the best k rows with a score of floor and more."""
        t, i, found = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n, bool)
        if not q["has_text"] and q["qv"] is None:
            score, found = np.floor(self.rated / 5 * 1e4 + 0.5) / 1e4, self.fits(q)
        else:
            if sums is not None:
                t, found = share(sums, best), sums > 0
            if q["qv"] is not None and len(q["qv"]) in self.pictures:
                at, x = self.pictures[len(q["qv"])]
                i[at] = np.maximum(np.floor(x @ unit(np.array([q["qv"]], float))[0] * 1e4 + 0.5) / 1e4, 0)
                found[at] = True
            score = np.floor(np.round((self.weight * t + (1 - self.weight if q["has_text"] else 1) * i) * 1e4, 5) + 0.5) / 1e4
            score, found = score[self.of], found[self.of] & self.fits(q)
        at = np.flatnonzero(found & (score >= floor))
        if len(at) > self.k:
            at = at[score[at] >= np.partition(score[at], len(at) - self.k)[len(at) - self.k]]
        at = at[np.lexsort((self.last[at], -self.rated[at], -score[at]))[: self.k]]
        return at, score[at], t[self.of[at]], i[self.of[at]]


def _scorer(k: int, weight: float, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}  # the best rows of each query so far, in order

        def add(block: _Block, q: dict, sums: np.ndarray | None, best: float = 1.0) -> None:
            old = held.get(q["query_id"], [])
            at, *scores = block.hits(q, sums, best, -old[-1][0][0] if len(old) == k else -np.inf)
            if len(at):
                take = lambda x: x.take(pa.array(at)).to_pylist()
                rows = zip(*((-x).tolist() for x in (scores[0], block.rated[at])), block.last[at].tolist())
                plain = zip([q["query_id"]] * len(at), take(block.names.take(pa.array(block.of))), take(block.row_id), take(block.rating), [q["max_value"]] * len(at), *(x.tolist() for x in scores))
                held[q["query_id"]] = sorted([*old, *zip(rows, plain)], key=lambda x: x[0])[:k]

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block = _Block(row, kind, k, weight)
                at, tf = (np.frombuffer(row[c].as_py(), "<i4") for c in ("rows", "tf"))
                asked = {q["query_id"]: q for q in row["asked"].as_py()}
                if row["entries"].is_valid:
                    entries = row["entries"].values
                    best = entries.field("best").to_numpy(zero_copy_only=False)
                    for part, s, entry in sums(row["terms"].values, row["df"].values.to_numpy(zero_copy_only=False), at, block.n, entries, lambda of, qtf, idf: np.minimum(tf[of], qtf) * idf):
                        for j, number in enumerate(part.tolist()):
                            add(block, asked.pop(number), s[j], best[entry[j]])
                for q in asked.values():  # without terms that a document has
                    add(block, q, None)
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in HITS.split(", ")])
        rows = [list(plain) for found in held.values() for _, plain in found]
        for x in rows:  # ratings stand for scores where there is no condition
            x[5] = None if x[5] == -np.inf else float("nan") if x[5] == np.inf else x[5]
        for low in range(0, len(rows), 10_000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + 10_000]), schema)], schema=schema)

    return run


@dataclass
class Hybrid:
    """The baseline of a catalog, whose blocks hold its rows and pictures, too; kind: how elements of vectors are stored."""

    baseline: Baseline
    kind: str

    @staticmethod
    def build(docs: DataFrame, terms: Callable[[Column], Column], pictures: DataFrame) -> Hybrid:
        """docs(doc_id, text, row_id, rating, value, category); pictures(doc_id, v): one for a document, of documents that have one."""
        element = pictures.schema["v"].dataType.elementType.simpleString()
        rows = documents(docs, F.collect_list(F.struct("row_id", "rating", "value", "category")).alias("items")).join(pictures, "doc_id", "left")
        schema = f"{BLOCKS}, of binary, row_id array<long>, rating array<double>, value array<double>, category array<string>, pictured binary, d binary, x binary"
        blocks = rows.select("doc_id", terms(F.col("text")).alias("terms"), "items", "v").mapInArrow(packer(_more), schema)
        return Hybrid(Baseline.of(blocks, docs), "<f4" if element == "float" else "<f8")

    def search(self, queries: DataFrame, wanted: DataFrame, k: int = 10, weight: float = 0.65) -> DataFrame:
        """fusion.hybrid() of queries(query_id, has_text, qv, max_value, category, excluded): qv is the vector of a query's image, null
        without one. wanted(query_id, term, qtf): the queries' tokens."""
        if not 0 <= weight <= 1:
            raise ValueError("weight lies between 0 and 1")
        queries = written(queries.select("query_id", "has_text", F.col("qv").cast("array<double>").alias("qv"), "max_value", "category", "excluded"))
        weighted = written(self.baseline.weighted(wanted.join(queries.where("has_text").select("query_id"), "query_id")))
        entries = weighted.join(self.baseline.best(weighted), "query_id")
        # A chunk has about ENTRIES numbers of vectors and terms at most.
        chunks = 1 + (weighted.count() + (queries.agg(F.sum(1 + F.coalesce(F.size("qv"), F.lit(0)))).first()[0] or 0) // 4) // ENTRIES
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
        asked = queries.groupBy(chunk).agg(F.collect_list(F.struct(*queries.columns)).alias("asked"))
        packed = asked.join(entries.groupBy(chunk).agg(F.collect_list(F.struct(*entries.columns)).alias("entries")), "chunk", "left")
        blocks = self.baseline.blocks
        found = meet(blocks, packed, chunks, "rows").select(*blocks.columns, "asked", "entries").mapInArrow(_scorer(k, weight, self.kind), HITS)
        return first_hybrid(found, k)
