"""Seeded synthetic catalogs and vectors; each row depends on its number and the seed alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.dense import exact_search

COLOURS = ("白色", "黑色", "灰色", "蓝色", "红色", "绿色", "橙色", "米色")
STYLES = ("简约", "复古", "运动", "通勤", "户外", "商务")


def _uniform(row: Column, seed: int, salt: int) -> Column:
    bits = F.xxhash64(row, F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def catalog(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(product_id, category, colour, style, price, rating, stock): log-normal prices, uniform ratings and stocks."""
    row = F.col("id")
    normal = F.sqrt(-2 * F.log(_uniform(row, seed, 1))) * F.cos(2 * np.pi * _uniform(row, seed, 2))
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), (F.floor(_uniform(row, seed, salt) * len(names)) + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("syn%07d", row).alias("product_id"),
        F.format_string("类目%d", F.floor(_uniform(row, seed, 3) * 10)).alias("category"),
        pick(COLOURS, 4).alias("colour"),
        pick(STYLES, 5).alias("style"),
        F.round(F.exp(6.0 + 0.8 * normal), 2).alias("price"),
        F.round(3.5 + 1.5 * _uniform(row, seed, 6), 2).alias("rating"),
        F.floor(_uniform(row, seed, 7) * 200).cast("int").alias("stock"),
    )


def vectors(spark: SparkSession, n: int, dim: int = 32, clusters: int = 16, spread: float = 0.5, seed: int = 7) -> DataFrame:
    """(vec_id, cluster, vector): unit vectors around unit centres, each centre plus spread times unit noise."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.random.default_rng(seed).standard_normal((clusters, dim))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            noise = np.stack([np.random.default_rng((seed, int(i))).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))
            x = centres[ids % clusters] + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.record_batch([batch.column(0), pa.array((ids % clusters).astype(np.int32)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["vec_id", "cluster", "vector"])

    return spark.range(n).mapInArrow(run, "vec_id long, cluster int, vector array<float>")


def corpus_truth(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact answers to queries(query_id, vector) over a corpus(vec_id, …, vector)."""
    return exact_search(corpus.select("vec_id", "vector"), queries.select("query_id", "vector"), k, "cosine")


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """A unit vector that a text alone determines, the same in every process."""
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big") % (1 << 32)
    x = np.random.default_rng(seed).normal(size=dim).astype(np.float32)
    return x / max(np.linalg.norm(x), 1e-12)


def hash_vectors(texts: Column, dim: int = 32) -> Column:
    """hash_vector() of each text."""
    return F.arrow_udf(lambda t: pa.array([hash_vector(x, dim).tolist() for x in t.to_pylist()], pa.list_(pa.float32())), "array<float>")(texts)
