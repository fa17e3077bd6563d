"""Mixing sources to target shares of all tokens, small sources repeated up to a cap.

The tokens of a source are packed into blocks of BLOCK tokens: its documents lie one after the other, by chunks that a hash
of their ids gives and then by id, and are cut where a block ends, so only a source's last block is short. A mix is as
large as the caps allow with every share met. Its blocks are laid out in output shards: the source counts of a shard are
multinomial draws given the sources' totals, so shares hold exactly and not on average; a tree of splits draws them, each
shard by itself, for any number of shards. The j-th block that a source gives is its block number perm(j mod blocks) of
round j div blocks: a pseudorandom index permutation, different in each round. Shards are joined with blocks by index
alone. A part of a document is used as often as the draws name its block; repeats are read off the same draws, by the
inverse permutation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.tokens import VOCABULARY, count_tokens
from quillstone.session import cut

BLOCK = 1024
#: Tokens, about, of a chunk of documents whose positions are summed up in one group.
CHUNK_TOKENS = 2_000_000
#: Blocks of an output shard, about.
SHARD_BLOCKS = 256
#: Rows of this many or more are split between shards by the normal limit of the exact law, which numpy doesn't draw from there.
MANY = 10**9


def plain_source(source: Column) -> Column:
    """Lower case, no padding, words joined by '-'; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_-]+", "-")


def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The image of index under a pseudorandom permutation of range(size), chosen by key; or its inverse.

    A Feistel network over the next even power of two, walked on until the value is below size.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, key, size = index.astype(np.uint64), key.astype(np.int64).view(np.uint64), size.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in reversed(range(4)) if inverse else range(4):
            salt = k + np.uint64(r * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            if inverse:
                left, right = right ^ ((_scramble(left, salt) >> np.uint64(33)) & m), left
            else:
                left, right = right, left ^ ((_scramble(right, salt) >> np.uint64(33)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Corpus:
    """docs: (doc_id, source, n_tokens, first): first is a document's place among the tokens of its source; sources: source -> tokens."""

    docs: DataFrame
    sources: dict[str, int]


@dataclass
class Part:
    """A source in a mix: its tokens and blocks, and how many blocks the mix draws of it."""

    mix: int
    source: str
    target: float
    cap: int
    tokens: int
    drawn: int = 0

    @property
    def key(self) -> int:
        return hash_of(f"{self.mix}/{self.source}")

    @property
    def blocks(self) -> int:
        return -(-self.tokens // BLOCK)


def hash_of(text: str) -> int:
    """A stable 62-bit hash."""
    import hashlib

    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 2


def lay_out(sizes: DataFrame, targets: DataFrame) -> Corpus:
    """Places of the documents (doc_id, source, n_tokens) of the sources that targets name; those without source or tokens are left out."""
    wanted = targets.select(plain_source(F.col("source")).alias("source")).where("source is not null").distinct()
    sized = cut(sizes.where("source is not null and n_tokens > 0 and doc_id is not null").join(F.broadcast(wanted), "source", "left_semi"))
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # as many rows as targets, at most
    if not totals:
        return Corpus(sized.withColumn("first", F.lit(0).cast("long")), {})
    chunks = F.create_map(*(F.lit(x) for s, n in totals.items() for x in (s, 1 + n // CHUNK_TOKENS)))
    chunked = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks[F.col("source")]))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("source", "chunk", F.coalesce(F.sum("n").over(before("source").orderBy("chunk")), F.lit(0)).alias("chunk_start"))
    placed = chunked.withColumn("local", F.coalesce(F.sum("n_tokens").over(before("source", "chunk").orderBy("doc_id", "n_tokens")), F.lit(0)))
    docs = placed.join(starts, ["source", "chunk"]).select("doc_id", "source", "n_tokens", (F.col("chunk_start") + F.col("local")).alias("first"))
    return Corpus(cut(docs), totals)


def plan(corpus: Corpus, targets: DataFrame) -> list[Part]:
    """The parts of each mix, as large as the caps allow while all shares are met.

    Sources without documents give nothing; the others keep their proportions. A null or negative share or cap counts as
    none, and a source named twice in a mix counts once, with its shares added and its larger cap.
    """
    rows: dict[tuple[int, str], list[float]] = {}
    for r in targets.select("mix_id", plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        if r["mix_id"] is not None and r["source"]:
            to = rows.setdefault((r["mix_id"], r["source"]), [0.0, 0])
            to[0] += max(0.0, r["target_share"] or 0.0)
            to[1] = max(to[1], r["max_repeats"] or 0)
    parts = []
    for mix in sorted({m for m, _ in rows}):
        of = [Part(mix, s, share, int(cap), corpus.sources.get(s, 0)) for (m, s), (share, cap) in sorted(rows.items()) if m == mix]
        total = min((p.cap * p.tokens / p.target for p in of if p.target and p.tokens and p.cap), default=0.0)
        for p in of:
            if p.tokens and p.cap:
                p.drawn = min(p.cap * p.blocks, round(total * p.target * p.blocks / p.tokens))
        parts += of
    return parts


def split_between(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n rows drawn without replacement come from each group of left rows; one group after the other."""
    out, rest, of = np.zeros_like(left), int(n), int(left.sum())
    for i, here in enumerate(left.tolist()):
        others = of - here
        low, high = max(0, rest - others), min(here, rest)
        if low == high:
            out[i] = low
        elif of < MANY:
            out[i] = rng.hypergeometric(here, others, rest)
        else:
            share = here / of
            spread = np.sqrt(rest * share * (1 - share) * ((of - rest) / max(1, of - 1)))
            out[i] = min(high, max(low, round(rest * share + spread * rng.standard_normal())))
        rest, of = rest - int(out[i]), others
    return out


def shard_draw(drawn: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(used, taken) of each source: what the shards before this one draw of it, and what this one draws.

    Shards are the leaves of a tree; at each node the sources' counts are split between its halves by a generator that
    the node seeds, so all shards agree on the splits above them, and none needs the others.
    """
    low, high, used, taken = 0, shards, np.zeros_like(drawn), drawn
    while high - low > 1:
        middle = (low + high) // 2
        n = int(taken.sum()) * (middle - low) // (high - low)
        first = split_between(taken, n, np.random.default_rng([seed, low, high]))
        if shard < middle:
            high, taken = middle, first
        else:
            low, used, taken = middle, used + first, taken - first
    return used, taken


def _by_mix(parts: list[Part]) -> dict[int, list[Part]]:
    return {m: [p for p in parts if p.mix == m] for m in sorted({p.mix for p in parts})}


def mixed_blocks(corpus: Corpus, parts: list[Part], seed: int = 5) -> DataFrame:
    """(mix_id, shard, slot, source, round, block_no, n_tokens): the blocks of each mix in the order of its output shards.

    All blocks have BLOCK tokens but the last one of a source.
    """
    spark = corpus.docs.sparkSession
    schema = "mix_id int, shard long, slot int, source string, round long, block_no long, n_tokens long"
    whole = []
    for mix, named in _by_mix(parts).items():
        of = [p for p in named if p.drawn]
        drawn = np.array([p.drawn for p in of], np.int64)
        shards = -(-int(drawn.sum()) // SHARD_BLOCKS)

        def run(batches: Iterable[pa.RecordBatch], mix=mix, of=of, drawn=drawn, shards=shards) -> Iterator[pa.RecordBatch]:
            blocks, keys, last = (np.array([f(p) for p in of], np.int64) for f in (lambda p: p.blocks, lambda p: p.key, lambda p: p.tokens - (p.blocks - 1) * BLOCK))
            names = pa.array([p.source for p in of])
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    used, taken = shard_draw(drawn, shards, shard, seed + mix)
                    source = np.repeat(np.arange(len(of)), taken)
                    j = used[source] + np.arange(len(source)) - np.repeat(np.cumsum(taken) - taken, taken)
                    turn = j // blocks[source]
                    block = permuted(j % blocks[source], blocks[source], keys[source] + turn)
                    order = np.random.default_rng([seed, mix, shard]).permutation(len(source))
                    source, turn, block = source[order], turn[order], block[order]
                    n = np.where(block == blocks[source] - 1, last[source], BLOCK)
                    size = len(source)
                    yield pa.record_batch([pa.array(np.full(size, mix, np.int32)), pa.array(np.full(size, shard)), pa.array(np.arange(size, dtype=np.int32)), names.take(pa.array(source)), pa.array(turn), pa.array(block), pa.array(n)], names=["mix_id", "shard", "slot", "source", "round", "block_no", "n_tokens"])

        whole.append(spark.range(shards).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, whole) if whole else spark.createDataFrame([], schema)


def block_parts(corpus: Corpus) -> DataFrame:
    """(source, block_no, at, doc_id, start_token, n_tokens): what lies in each block, from token at on; a document is cut at block ends."""
    end = F.col("first") + F.col("n_tokens")
    spread = corpus.docs.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((end - 1) / BLOCK))))
    low, high = F.greatest("first", F.col("block_no") * BLOCK), F.least(end, (F.col("block_no") + 1) * BLOCK)
    return spread.select("source", "block_no", (low - F.col("block_no") * BLOCK).alias("at"), "doc_id", (low - F.col("first")).alias("start_token"), (high - low).alias("n_tokens"))


def filled_blocks(corpus: Corpus, parts: list[Part], seed: int = 5) -> DataFrame:
    """(mix_id, shard, slot, at, doc_id, start_token, n_tokens): the content of mixed_blocks(), joined by index. One source's blocks
    are spread over all tasks, as the block number is part of the key."""
    blocks = mixed_blocks(corpus, parts, seed).select("mix_id", "shard", "slot", "source", "block_no")
    # A plan knows nothing of how many blocks a shard makes, so it must not choose to broadcast them.
    return blocks.hint("merge").join(block_parts(corpus), ["source", "block_no"]).select("mix_id", "shard", "slot", "at", "doc_id", "start_token", "n_tokens")


def repeats(block: np.ndarray, blocks: np.ndarray, drawn: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often the draws of a source name a block: in each whole round, and in the last one if its place there is drawn."""
    rounds, rest = drawn // blocks, drawn % blocks
    return rounds + (permuted(block, blocks, key + rounds, inverse=True) < rest)


def mixed_documents(corpus: Corpus, parts: list[Part]) -> DataFrame:
    """(mix_id, doc_id, source, part_no, start_token, n_tokens, repeats): every document of the mix's sources, with how often it is used.

    A document is in one part unless its blocks are used a different number of times; then it is in as many parts as it takes.
    """
    schema = "mix_id int, doc_id long, source string, part_no int, start_token long, n_tokens long, repeats long"
    of_source: dict[str, list[Part]] = {}
    for p in parts:
        if p.tokens:
            of_source.setdefault(p.source, []).append(p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, firsts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            names = np.array(batch.column(1).to_pylist(), object)
            for source in dict.fromkeys(names):
                rows = np.flatnonzero(names == source)
                first, end = firsts[rows], firsts[rows] + sizes[rows]
                low = first // BLOCK
                n = (end - 1) // BLOCK - low + 1
                owner = np.repeat(np.arange(len(rows)), n)
                block = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                for p in of_source.get(source, []):
                    many = lambda x: np.full(len(block), x, np.int64)
                    used = repeats(block, many(p.blocks), many(p.drawn), many(p.key))
                    new = np.append(True, (np.diff(owner) != 0) | (np.diff(used) != 0))
                    at = np.flatnonzero(new)
                    doc = owner[at]
                    start = np.maximum(first[doc], block[at] * BLOCK)
                    whole = np.append(doc[1:] != doc[:-1], True)  # the last part of its document
                    stop = np.where(whole, end[doc], np.append(block[at[1:]] * BLOCK, 0))
                    number = np.arange(len(at)) - np.maximum.accumulate(np.where(np.append(True, np.diff(doc) != 0), np.arange(len(at)), 0))
                    size = len(at)
                    yield pa.record_batch([pa.array(np.full(size, p.mix, np.int32)), pa.array(ids[rows][doc]), pa.array([source] * size, pa.string()), pa.array(number.astype(np.int32)), pa.array(start - first[doc]), pa.array(stop - start), pa.array(used[at])], names=["mix_id", "doc_id", "source", "part_no", "start_token", "n_tokens", "repeats"])

    return corpus.docs.select("doc_id", "source", "n_tokens", "first").mapInArrow(run, schema)


def share_report(corpus: Corpus, parts: list[Part]) -> DataFrame:
    """(mix_id, source, target_share, share, tokens, available_tokens, times_used, max_repeats) for each target of each mix."""
    used = mixed_documents(corpus, parts).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    rows = [(p.mix, p.source, p.target, p.tokens, p.cap) for p in parts]
    wanted = corpus.docs.sparkSession.createDataFrame(rows, "mix_id int, source string, target_share double, available_tokens long, max_repeats int")
    both = wanted.join(used, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_id")))
    return both.select("mix_id", "source", "target_share", share.alias("share"), "tokens", "available_tokens", F.try_divide(F.col("tokens"), F.col("available_tokens")).alias("times_used"), "max_repeats")


def share_check(corpus: Corpus, parts: list[Part]) -> DataFrame:
    """(mix_id, source, target_share, available, reachable_share, share_met, cap_kept, none_lost) for each target of each mix.

    reachable_share is the target's part of the targets that have documents; it is met if the tokens used are within two
    blocks of it (a block of its own, and rounding of the others). cap_kept: no token is used more than max_repeats times;
    none_lost: the parts of the documents add up to the source.
    """
    docs = mixed_documents(corpus, parts).groupBy("mix_id", "source")
    used = docs.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"), F.sum("n_tokens").alias("found"))
    live = {m: sum(p.target for p in of if p.tokens and p.cap) for m, of in _by_mix(parts).items()}
    rows = [(p.mix, p.source, p.target, p.tokens, p.cap, p.target / live[p.mix] if p.tokens and p.cap and live[p.mix] else 0.0) for p in parts]
    named = corpus.docs.sparkSession.createDataFrame(rows, "mix_id int, source string, target_share double, tokens long, cap long, reachable_share double")
    both = named.join(used, ["mix_id", "source"], "left").fillna(0, ["used", "most", "found"])
    off = F.abs(F.col("used") - F.col("reachable_share") * F.sum("used").over(Window.partitionBy("mix_id")))
    return both.select("mix_id", "source", "target_share", (F.col("tokens") > 0).alias("available"), "reachable_share", (off <= 2 * BLOCK).alias("share_met"), (F.col("most") <= F.col("cap")).alias("cap_kept"), (F.col("found") == F.col("tokens")).alias("none_lost"))


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) with plain source names."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_source(F.col("source")).alias("source"), count_tokens(F.col("text"), vocabulary).alias("n_tokens"))
