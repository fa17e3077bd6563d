"""The same and nearly the same records across splits.

Titles are brought to their look-alike form, lower case, letters and digits. Winnowing takes from every stretch of WINDOW
overlapping GRAM-character pieces the one that is rarest in the corpus (a histogram of fixed size says how rare; a hash
decides ties), so template wording that thousands of titles share is hardly ever selected. Of these fingerprints a title
keeps the rarest ones, one more than the edits that SIMILARITY allows can destroy. Titles with few pieces use the prefix
filter over their three-character pieces in the same order, which loses nothing. Fingerprints are joined across the
splits; a pair is a candidate only if the sizes and the 128-bit sketches of its piece sets leave the similarity
possible, a test that never drops a pair that reaches it. Candidates' seeds are chained in order, the chain is extended
over equal characters, and the exact similarity decides; the chain's coverage is reported.

Only distinct titles are compared: a title of a third of all records is one row until pairs are written out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.lookalike import canonical, per_text, shapes
from quillstone.llm.spans import Rolling, _slide, mixed
from quillstone.session import written

SIMILARITY = 0.78
PIECE, GRAM, WINDOW = 3, 6, 3
#: Titles of up to FEW different pieces use the prefix filter, those of at least MANY fingerprints; pairs within
#: SIMILARITY of each other always share one of the two.
MANY, FEW = 22, 29
#: Cells of the histogram of pieces that is sent to all tasks (a byte each): four for each title, but within these bounds, so at most 16 MB.
CELLS = 1 << 16, 1 << 24
#: Bits of the sketch of a title's pieces.
SKETCH = 128


def plain_split(split: Column) -> Column:
    """train, validation or test; null if not assigned or unknown."""
    name = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(name.isin("val", "valid", "dev", "validation"), "validation").when(name.isin("train", "test"), name)


def plain_hash(image: Column) -> Column:
    """The hexadecimal hash without case, padding or prefix; null if there is none."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(image, r"^\s+|\s+$", "")), r"^sha256:\s*", "")
    return F.when(plain != "", plain)


def plain_title(text: str | None, form=canonical) -> str | None:
    """Look-alike form, lower case, letters and digits only; null if nothing is left."""
    return "".join(filter(str.isalnum, form(text).lower())) or None if text else None


def pieces(text: str) -> set[str]:
    """The three-character pieces; a shorter text is its own piece."""
    return {text[i : i + PIECE] for i in range(len(text) - PIECE + 1)} or {text}


def _titles(texts: list[str]):
    """(offsets, rolling hashes, owner and hash of each distinct piece) of texts, none empty."""
    offsets = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    rolling = Rolling(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    return offsets, rolling


def _grams(offsets: np.ndarray, rolling: Rolling, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, position, hash) of all overlapping pieces of a size; a shorter text has one, itself."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - size + 1, 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.append(0, np.cumsum(counts))[:-1], counts)
    start = offsets[owner] + place
    return owner, place, rolling.of(start, np.minimum(start + size, offsets[owner + 1]))


def _distinct(owner: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first row of each hash of each owner."""
    order = np.lexsort((place, h, owner))
    new = np.append(True, (np.diff(owner[order]) != 0) | (h[order][1:] != h[order][:-1]))
    return np.sort(order[new])


def cell_count(titles: int) -> int:
    """A power of two."""
    return max(CELLS[0], min(CELLS[1], 1 << (4 * titles).bit_length()))


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _histogram(cells: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                offsets, rolling = _titles(batch.column(0).to_pylist())
                for size in (PIECE, GRAM):
                    owner, place, h = _grams(offsets, rolling, size)
                    total += np.bincount(_cells(h[_distinct(owner, place, h)], cells), minlength=cells)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    return run


def _first_of_each(owner: np.ndarray, key: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The rows of each owner with the lowest keys, as many as many[owner] says."""
    order = np.lexsort((key, owner))
    start = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0)) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < many[owner[order]]]


def fingerprints(texts: list[str], rarity: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, position, seed) of the selected fingerprints, and (number of pieces, sketch) of each text."""
    offsets, rolling = _titles(texts)
    n = len(texts)
    owner, place, h = _grams(offsets, rolling, PIECE)
    keep = _distinct(owner, place, h)
    owner, place, h = owner[keep], place[keep], h[keep]
    size = np.bincount(owner, minlength=n)
    bit = ((mixed(h) >> np.uint64(32)) % np.uint64(SKETCH)).astype(np.int64)
    sketch = np.zeros((n, SKETCH), bool)
    sketch[owner, bit] = True
    sketch = np.packbits(sketch, axis=1, bitorder="little").view("<i8")

    def order(x: np.ndarray) -> np.ndarray:  # rarest first; never the greatest value
        return (rarity[_cells(x, len(rarity))].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(9))

    few = size[owner] <= FEW
    prefix = size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1
    short = np.flatnonzero(few)[_first_of_each(owner[few], order(h[few]), prefix)]
    out = [(owner[short], place[short], h[short])]

    owner, place, h = _grams(offsets, rolling, GRAM)
    large = size[owner] >= MANY
    owner, place, h = owner[large], place[large], h[large]
    if len(owner):
        key = order(h)
        low = _slide(key, WINDOW, np.minimum) if len(key) >= WINDOW else key[:0]
        within = owner[: len(low)] == owner[len(key) - len(low) :]  # the stretch lies in one text
        low = np.where(within, low, 0)
        pad = np.zeros(WINDOW - 1, np.uint64)
        chosen = np.flatnonzero(key == _slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum)[: len(key)])
        chosen = chosen[_distinct(owner[chosen], place[chosen], h[chosen])]
        kept = chosen[_first_of_each(owner[chosen], key[chosen], np.ceil(0.2 * size).astype(np.int64) + 3)]
        out.append((owner[kept], place[kept], h[kept]))
    return *(np.concatenate(x) for x in zip(*out)), size, sketch


#: size: number of pieces x 2^32 + position of the fingerprint.
SEEDS = "seed long, c long, size long, b0 long, b1 long"


def _seeder(rarity):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, place, seed, size, sketch = fingerprints(batch.column(0).to_pylist(), rarity.value)
                columns = [pa.array(seed.view(np.int64)), batch.column(1).take(pa.array(owner)), pa.array((size[owner] << 32) | place), *(pa.array(sketch[owner, i]) for i in range(2))]
                yield pa.record_batch(columns, names=["seed", "c", "size", "b0", "b1"])

    return run


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain of seeds (place in a, place in b), both places rising."""
    best: list[int] = []
    ends: list[int] = []
    back: dict[int, int] = {}
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    for i, (_, y) in enumerate(seeds):
        at = bisect_left(best, y)
        best[at:], ends[at:] = ([y], [i]) if at == len(best) else ([y, *best[at + 1 :]], [i, *ends[at + 1 :]])
        back[i] = ends[at - 1] if at else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def aligned(a: str, b: str, seeds: list[tuple[int, int]]) -> int:
    """Characters of a that are matched when the chained seeds are extended over equal characters, without overlap."""
    total, done_a, done_b = 0, 0, 0
    for x, y in chain(seeds):
        if x < done_a or y < done_b:
            continue
        left = 0
        while x - left > done_a and y - left > done_b and a[x - left - 1] == b[y - left - 1]:
            left += 1
        right = 0
        while x + right < len(a) and y + right < len(b) and a[x + right] == b[y + right]:
            right += 1
        total, done_a, done_b = total + left + right, x + right, y + right
    return total


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b, seeds in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x, y = pieces(a), pieces(b)
            both = len(x & y)
            if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-12:
                rows.append((a, b, both / (len(x) + len(y) - both), aligned(a, b, [(s["x"], s["y"]) for s in seeds]) / len(a)))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["a", "b", "similarity", "coverage"])


def similar_titles(classes: DataFrame) -> DataFrame:
    """(a, b, similarity, coverage): different titles a (in train) and b (in another split) that are nearly the same.

    classes: distinct non-empty titles t with their hash c, and flags train and other for where they occur.
    """
    cells = cell_count(classes.count())
    rarity = np.zeros(cells, np.uint8)
    for batch in classes.select("t").mapInArrow(_histogram(cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        rarity[batch.column(0).to_numpy(zero_copy_only=False)] = np.minimum(254, 1 + 8 * np.log2(batch.column(1).to_numpy(zero_copy_only=False))).astype(np.uint8)
    rarity = classes.sparkSession.sparkContext.broadcast(rarity)
    seeds = lambda side: classes.where(side).select("t", "c").mapInArrow(_seeder(rarity), SEEDS).alias(side[0])
    apart = sum((F.bit_count(F.col(f"t.b{i}").bitwiseXOR(F.col(f"o.b{i}"))) for i in range(2)), F.lit(0))
    n = {s: F.shiftright(f"{s}.size", 32) for s in "to"}
    possible = (F.col("t.seed") == F.col("o.seed")) & (F.col("t.c") != F.col("o.c")) & (F.least(*n.values()) >= SIMILARITY * F.greatest(*n.values()) - 1e-9) & (apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n["t"] + n["o"]) + 1e-9)
    place = {s: F.col(f"{s}.size").bitwiseAND(F.lit((1 << 32) - 1)) for s in "to"}
    hits = seeds("train").join(seeds("other"), possible).select(F.col("t.c").alias("ca"), F.col("o.c").alias("cb"), F.struct(place["t"].alias("x"), place["o"].alias("y")).alias("s"))
    candidates = written(hits.groupBy("ca", "cb").agg(F.collect_list("s").alias("seeds")))
    text = lambda side, c, t: classes.where(side).select(F.col("c").alias(c), F.col("t").alias(t))
    named = candidates.join(text("train", "ca", "a"), "ca").join(text("other", "cb", "b"), "cb").select("a", "b", "seeds")
    return named.mapInArrow(_verify, "a string, b string, similarity double, coverage double")


def prepared(products: DataFrame) -> DataFrame:
    """(id, split, source, image, t): plain forms of the products that belong to a split; written once."""
    form = shapes(products.sparkSession).canonical
    title = lambda text: per_text(lambda x: plain_title(x, form), text)
    named = products.select("id", plain_split(F.col("split")).alias("split"), F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), plain_hash(F.col("image_sha256")).alias("image"), title(F.col("title")).alias("t"))
    return written(named.where("id is not null and split is not null"))


def cross_split_pairs(products: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(train_id, other_id, same_image, similarity, coverage): every pair of a train record and one of validation or test
    with the same image or nearly the same title; similarity and coverage (of the train title) are null if only the image is.

    Null ids, splits, images and titles match nothing, nor do placeholder images; titles without letters or digits don't
    match either. Repeated rows give a pair once.
    """
    return _pairs(prepared(products), placeholders)


def _pairs(rows: DataFrame, placeholders: DataFrame) -> DataFrame:
    shown = rows.join(F.broadcast(placeholders.select(plain_hash(F.col("image_sha256")).alias("image")).distinct()), "image", "left_anti").where("image is not null")
    images = shown.where("split = 'train'").select("image", F.col("id").alias("train_id")).join(shown.where("split <> 'train'").select("image", F.col("id").alias("other_id")), "image")
    images = images.select("train_id", "other_id", F.lit(True).alias("same_image"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("coverage"))
    classes = rows.where("t is not null").groupBy("t").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") != "train").alias("other"))
    classes = written(classes.withColumn("c", F.xxhash64("t")))
    same = classes.where("train and other").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    pairs = written(similar_titles(classes).unionByName(same))
    # Ids are joined by two hashes of their titles, as those are much shorter; together they have 128 bits.
    hashed = lambda t: F.array(F.xxhash64(t), F.xxhash64(F.lit(1), t))
    side = lambda which, t, name: rows.where(which).where("t is not null").select(hashed("t").alias(t), F.col("id").alias(name))
    titles = pairs.select(hashed("a").alias("a"), hashed("b").alias("b"), "similarity", "coverage").join(side("split = 'train'", "a", "train_id"), "a").join(side("split <> 'train'", "b", "other_id"), "b")
    titles = titles.select("train_id", "other_id", F.lit(False).alias("same_image"), "similarity", "coverage")
    both = images.unionByName(titles).where("train_id <> other_id").groupBy("train_id", "other_id")
    return both.agg(F.bool_or("same_image").alias("same_image"), F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))


def overlap_report(products: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, pairs, by_image, by_title, mean_coverage): per split and source, how many
    records have a counterpart across the splits, in how many pairs, and the mean over records of their best title coverage."""
    rows = prepared(products)
    pairs = written(_pairs(rows, placeholders))
    sides = pairs.withColumnRenamed("train_id", "id").drop("other_id").unionByName(pairs.withColumnRenamed("other_id", "id").drop("train_id"))
    per_record = sides.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("same_image").alias("by_image"), F.count("similarity").alias("by_title"), F.max("coverage").alias("coverage"))
    counted = rows.select("id", "split", "source").join(per_record, "id", "left").groupBy("split", "source")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counted.agg(F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), total("pairs"), total("by_image"), total("by_title"), F.avg("coverage").alias("mean_coverage"))
