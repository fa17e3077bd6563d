"""Spans of LENGTH characters or more that stand word for word in other documents, and texts without their repetitions.

Sliding sentence spans: from the start of a sentence, the run of sentences that fits into SPAN characters is hashed, and
the hashes are joined over all documents. Two changes make the result exact to the character. A sentence may be longer
than a shared piece, so a start is needed every REACH characters: in each stretch of REACH positions the best start is
taken (a sentence's before a clause's before a word's before any; the hash of the characters before it decides ties),
and a run without a sentence's end in its last quarter is cut at SPAN. CONTEXT + REACH + SPAN = LENGTH + 1, so every
piece of LENGTH characters holds a run that starts alike wherever the piece stands. And repeated runs only name
candidates: around each, all pieces of LENGTH characters are hashed and joined again, and those in two documents are shared.

All joins count documents by hash. A batch first settles hashes that it has from two documents and sends two rows
of each onwards, so a span that a third of all documents hold is no hot key.

without_repetitions() is the cleaning step: from each sentence, the shortest run of consecutive sentences of LENGTH
characters or more is hashed and joined over all documents; a sentence goes if any such run covers it that also stands in a
document with a smaller id, so the first of all occurrences stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT, SPAN = 8, 120
#: Characters that are worked on at a time, so that memory doesn't follow the batch.
CHUNK = 1 << 20
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SENTENCE_ENDS, SOFT_ENDS, CLAUSE_ENDS = "。！？\n", ".!?", ",;:，；：、)）"


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, ODD, np.uint64), np.full(size, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit hash of each number."""
    x = x.astype(np.uint64) + np.uint64(ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a text in constant time; equal stretches have equal hashes wherever they stand."""

    def __init__(self, points: np.ndarray) -> None:
        self.up, self.down = _powers(1 << max(21, int(len(points)).bit_length()))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points) * self.up[: len(points)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, beyond, code points, offsets) of runs of texts of about CHUNK characters."""
    first, size = 0, 0
    for i in range(len(texts) + 1):
        n = len(texts[i] or "") if i < len(texts) else 0
        if i > first and (i == len(texts) or size + n > CHUNK):
            part = [x or "" for x in texts[first:i]]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            yield first, i, np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4"), np.append(0, np.cumsum(lengths))
            first, size = i, 0
        size += n


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (maximum or minimum) of each run of width values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def _marks() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for kind, signs in ((1, " "), (2, CLAUSE_ENDS), (3, SOFT_ENDS), (4, SENTENCE_ENDS)):
        for x in signs:
            table[ord(x)] = kind
    return table


MARKS = _marks()


def start_ranks(points: np.ndarray) -> np.ndarray:
    """How good a start each position is: 3 after a sentence, 2 after a clause, 1 after a space; from the two characters before."""
    kind = MARKS[np.minimum(points, 0xFFFF)]
    rank = np.zeros(len(points), np.uint8)
    before = kind[:-1]
    rank[1:] = np.where(before == 4, 3, np.where(before == 2, 2, np.where(before == 1, 1, 0)))
    rank[2:][(before[1:] == 1) & (kind[:-2] == 3)] = 3
    return rank


def anchors(points: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of each text; positions count from the chunk's start."""
    reach = length + 1 - CONTEXT - SPAN
    low, high = offsets[:-1] + CONTEXT, offsets[1:] - SPAN  # starts lie in [low, high]
    whole = high - low + 1 >= reach
    if not whole.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    edges = np.zeros(len(points) + 2, np.int32)
    np.add.at(edges, low[whole], 1)
    np.add.at(edges, high[whole] - reach + 2, -1)
    full = np.cumsum(edges)[: len(points) - reach + 1] > 0  # stretches that lie in one text's starts
    rolling, rank = Rolling(points), start_ranks(points)
    at = np.arange(CONTEXT, len(points))
    worth = np.zeros(len(points), np.uint64)
    worth[CONTEXT:] = (rolling.of(at - CONTEXT, at) >> np.uint64(3)) | (rank[CONTEXT:].astype(np.uint64) << np.uint64(61))
    best = np.where(full, _slide(worth, reach, np.maximum), np.uint64(MASK))
    pad = np.full(reach - 1, MASK, np.uint64)
    chosen = np.flatnonzero(worth == _slide(np.concatenate([pad, best, pad]), reach, np.minimum)[: len(points)])
    last = np.maximum.accumulate(np.where(rank == 3, np.arange(len(points)), 0))
    limit = chosen + SPAN
    end = last[np.minimum(limit, len(points) - 1)]
    end = np.where((end > chosen + SPAN * 3 // 4) & (end <= limit), end, limit)
    return chosen, end, rolling.of(chosen, end)


def _settled(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(several, low, key): whether this batch has a row's hash from two documents, and the lowest of them. Of such rows,
    those of the lowest and one of the highest document keep the hash as their key; the others get keys of their own, as
    the join has nothing more to tell them but which document is the first."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    low = np.repeat(d[start], size)
    several = np.repeat(d[start] != d[start + size - 1], size)
    kept = d == low
    kept[start + size - 1] = True
    key = np.where(kept, h, mixed(np.arange(len(h), dtype=np.uint64) ^ h))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return several[back], low[back], key[back].view(np.int64)


def _batch(found: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
    if found[0]:
        h, d, s, n = map(np.concatenate, found)
        several, low, key = _settled(h, d)
        yield pa.record_batch([pa.array(key), pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(several), pa.array(low)], names=["key", "doc", "start", "size", "several", "least"])


ROW = "key long, doc long, start int, size int, several boolean, least long"


def _anchor_rows(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            found: tuple[list, ...] = ([], [], [], [])
            for first, beyond, points, offsets in _chunks(texts):
                start, end, h = anchors(points, offsets, length)
                text = np.searchsorted(offsets, start, "right") - 1
                for to, x in zip(found, (h, ids[first:beyond][text], start - offsets[text], end - start)):
                    to.append(x)
            yield from _batch(found)

    return run


def _piece_rows(length: int):
    """Rows of all pieces of the given length around the candidate runs of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lists = batch.column(2)
            starts, sizes = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            found: tuple[list, ...] = ([], [], [], [])
            for first, beyond, points, offsets in _chunks(texts):
                of = (owner >= first) & (owner < beyond)
                at, own = starts[of], owner[of] - first
                low = offsets[own] + np.maximum(0, at + sizes[of] - length)
                high = np.minimum(offsets[own] + at, offsets[own + 1] - length)
                ok = high >= low
                edges = np.zeros(len(points) + 2, np.int32)
                np.add.at(edges, low[ok], 1)
                np.add.at(edges, high[ok] + 1, -1)
                piece = np.flatnonzero(np.cumsum(edges) > 0)
                if len(piece):
                    text = np.searchsorted(offsets, piece, "right") - 1
                    for to, x in zip(found, (Rolling(points).of(piece, piece + length), ids[first:beyond][text], piece - offsets[text], np.zeros(len(piece), np.int64))):
                        to.append(x)
            yield from _batch(found)

    return run


def _in_two(rows: DataFrame) -> DataFrame:
    """(doc, start, size, first): the rows whose hash two documents have; first: whether the document is the lowest of them."""
    of = Window.partitionBy("key")
    return rows.withColumns({"low": F.min("doc").over(of), "high": F.max("doc").over(of)}).where("several or low <> high").select("doc", "start", "size", (F.least("least", "low") == F.col("doc")).alias("first"))


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, start_char, end_char): the longest runs of characters that lie in pieces of the given length which other documents hold, too.

    Rows with a null id or text, and texts shorter than length, share nothing; rows of one id are one document, whose
    repetitions of its own text don't count. length is at least 129 plus a few.
    """
    texts = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and length(text) >= {int(length)}")
    runs = _in_two(texts.mapInArrow(_anchor_rows(length), ROW))
    wanted = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    pieces = _in_two(texts.join(wanted, "doc").select("doc", "text", "runs").mapInArrow(_piece_rows(length), ROW))
    by_doc = Window.partitionBy("doc").orderBy("start")
    # Rows of one id repeat their starts; the lag of such a row is 0, so they need no distinct().
    islands = pieces.select("doc", "start").withColumn("new", F.coalesce(F.col("start") - F.lag("start").over(by_doc) > length, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by_doc))
    spans = islands.groupBy("doc", "island").agg(F.min("start").cast("int").alias("start_char"), (F.max("start") + length).cast("int").alias("end_char"))
    return spans.select(F.col("doc").alias("doc_id"), "start_char", "end_char")


def shared_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_spans, share) for every document; a null or empty text has a null share."""
    spans = shared_spans(documents, key, text, length).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    sizes = documents.select(F.col(key).cast("long").alias("doc_id"), F.length(text).alias("n_chars"))
    both = sizes.join(spans, "doc_id", "left").withColumns({"shared_chars": F.coalesce("shared_chars", F.lit(0)), "n_spans": F.coalesce("n_spans", F.lit(0))})
    return both.withColumn("share", F.try_divide(F.col("shared_chars"), F.col("n_chars")))


def sentence_starts(text: str) -> list[int]:
    """Where sentences start, and the text's length: after an end of a sentence and the white space that follows it."""
    marks = start_ranks(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")) == 3
    return [0, *(int(i) for i in np.flatnonzero(marks) if i), len(text)]


def _sentence_runs(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for first, beyond, points, offsets in _chunks(texts):
                rolling = Rolling(points)
                for i in range(first, beyond):
                    at = np.array(sentence_starts(texts[i]), np.int64)
                    end = np.searchsorted(at, at[:-1] + length)
                    ok = end < len(at)
                    start, end = at[:-1][ok], at[end[ok]]
                    h = rolling.of(offsets[i - first] + start, offsets[i - first] + end)
                    # A run's end follows from its start; its size makes room for a check of its text.
                    for to, x in zip(found, (h, np.full(len(start), ids[i]), start, h >> np.uint64(33))):
                        to.append(x)
            yield from _batch(found)

    return run


def _cleaned(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text or not found:
                    rows.append((doc, text, 0, 0))
                    continue
                at = np.array(sentence_starts(text), np.int64)
                start, check = (np.array([f[c] for f in found], np.int64) for c in ("start", "size"))
                i, j = np.searchsorted(at, start), np.searchsorted(at, start + length)
                ok = j < len(at)
                i, j, check = i[ok], j[ok], check[ok]
                rolling = Rolling(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
                mine = (rolling.of(at[i], at[j]) >> np.uint64(33)).astype(np.int64) == check  # not of another row of this id
                gone = np.zeros(len(at), np.int64)
                np.add.at(gone, i[mine], 1)
                np.add.at(gone, j[mine], -1)
                keep = np.cumsum(gone)[:-1] == 0
                left = "".join(text[a:b] for a, b, k in zip(at.tolist(), at[1:].tolist(), keep) if k)
                rows.append((doc, left, int((~keep).sum()), len(text) - len(left)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "text", "removed_sentences", "removed_chars"])

    return run


def without_repetitions(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, text, removed_sentences, removed_chars) of every row: texts without the sentences that a repeated run covers
    which stands in a document with a smaller id, too. A run is the shortest of consecutive sentences with length characters.

    A null text stays null; rows with a null id are kept as they are; rows of one id are one document, whose own repetitions stay.
    """
    texts = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    later = _in_two(texts.where("doc is not null and text is not null").mapInArrow(_sentence_runs(length), ROW)).where("not first")
    lists = later.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    return texts.join(lists, "doc", "left").select("doc", "text", "found").mapInArrow(_cleaned(length), "doc_id long, text string, removed_sentences int, removed_chars int")
