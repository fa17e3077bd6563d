import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixture, nearest, packing, spans, tokens


def brute_spans(docs, length):
    where = {}
    for i, text in docs:
        for p in range(len(text or "") - length + 1):
            where.setdefault(text[p : p + length], set()).add(i)
    out = []
    by_id = {}
    for i, text in docs:
        for p in range(len(text or "") - length + 1):
            if i is not None and len(where[text[p : p + length]] - {None}) > 1:
                by_id.setdefault(i, set()).add(p)
    for i, starts in by_id.items():
        runs = []
        for p in sorted(starts):
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + length
            else:
                runs.append([p, p + length])
        out += [(i, a, b) for a, b in runs]
    return sorted(out)


def test_spans_against_brute_force(spark, rows):
    rng = random.Random(2)
    alphabets = ["abcdefgh ,.", "仓库在小时内发出包裹，。", "ab"]
    text = lambda n, a: "".join(rng.choices(a, k=n))
    shared = [text(n, alphabets[k % 2]) for k, n in enumerate((150, 200, 201, 230, 420, 900))]
    docs = []
    for i in range(40):
        parts = [text(rng.randrange(0, 400), alphabets[i % 2])]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 60)
            parts += [s[cut:] if rng.random() < 0.5 else s, text(rng.randrange(0, 90), alphabets[i % 2])]
        docs.append((i, "".join(parts)))
    docs += [(100, "x" * 700), (101, "x" * 650), (102, "only mine " * 60), (103, None), (104, ""), (105, "short")]
    docs += [(200 + i, shared[5][:600]) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit(1), "key": F.lit(2), "start": F.lit(3)})
    got = rows(spans.shared_spans(table.repartition(3)))
    assert sorted(got) == brute_spans(docs, 200)
    shares = {r["doc_id"]: r for r in spans.shared_shares(table).collect()}
    assert len(shares) == len(docs) and shares[102]["shared_chars"] == 0 and shares[200]["share"] == 1.0 and shares[103]["share"] is None


def test_spans_of_repeated_rows_long_texts_and_none(spark, rows):
    long = "".join(random.Random(4).choices("abcdef ", k=1_200_000))
    docs = spark.createDataFrame([(1, long), (2, "y" * 50 + long[500_000:500_300]), (3, "z" * 300), (3, "z" * 300), (None, long)], "doc_id long, text string")
    assert rows(spans.shared_spans(docs)) == [(1, 500_000, 500_300), (2, 50, 350)]
    assert rows(spans.shared_spans(docs.limit(0))) == []


def brute_cleaning(docs, length):
    runs, first = {}, {}
    for i, text in docs:
        if i is None or text is None:
            continue
        at = spans.sentence_starts(text)
        for a in at[:-1]:
            end = next((b for b in at if b >= a + length), None)
            if end is not None:
                runs.setdefault((i, text), []).append((a, end))
                first[text[a:end]] = min(i, first.get(text[a:end], i))
    out = []
    for i, text in docs:
        at = spans.sentence_starts(text) if text else [0, 0]
        gone = [any(x <= a and b <= y and first[text[x:y]] < i for x, y in runs.get((i, text), [])) for a, b in zip(at, at[1:])]
        out.append((i, None if text is None else "".join(text[a:b] for a, b, g in zip(at, at[1:], gone) if not g), sum(gone)))
    return sorted(out, key=repr)


def test_cleaning_against_brute_force(spark, rows):
    rng = random.Random(5)
    sentence = lambda n: "".join(rng.choices("abcdefg hij", k=n)).strip() + rng.choice([". ", "! ", "。", "\n"])
    common = [sentence(rng.randrange(20, 160)) for _ in range(12)]
    docs = []
    for i in range(60):
        at = rng.randrange(0, 10)
        docs.append((i, "".join([sentence(60), *common[at : at + rng.randrange(0, 6)], sentence(90), *common[2:5]])))
    docs += [(100, docs[7][1]), (100, "alone. " * 60), (101, None), (102, ""), (103, "short."), (None, docs[7][1])]
    docs += [(200 + i, "".join(common)) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit(1), "found": F.lit(2)})
    got = rows(spans.without_repetitions(table.repartition(3)).select("doc_id", "text", "removed_sentences"))
    assert got == brute_cleaning(docs, 200)
    assert sum(r[2] for r in got) > 300 and rows(spans.without_repetitions(table.limit(0))) == []


def test_repeated_rows_of_an_id_in_other_batches(spark, rows):
    text = "".join(random.Random(9).choices("abcdef ", k=400))
    parts = [spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), spark.createDataFrame([(1, "q" * 30 + text)], "doc_id long, text string")]
    got = rows(spans.shared_spans(parts[0].coalesce(1).unionByName(parts[1].coalesce(1))))
    assert got == [(1, 0, 430), (2, 0, 400)]


def vectors(spark, items):
    return spark.createDataFrame(items, "vec_id long, vectors array<float>, dimension int").withColumns({"id": F.lit(1), "g": F.lit(2)})


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((700, 24))
    x = np.repeat(centres, 9, axis=0) + 0.2 * rng.standard_normal((6300, 24))
    x *= rng.uniform(0.1, 20, (6300, 1))
    items = [(i, v.tolist(), 24) for i, v in enumerate(x)]
    got = nearest.nearest(vectors(spark, items)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, 6300, 20)
    truth = {(i, int(j)) for i in asked for j in np.argsort(-(unit[i] @ unit.T + np.where(np.arange(6300) == i, -9, 0)))[:5]}
    found = {(r["vec_id"], r["neighbour"]) for r in got}
    assert len(truth & found) / len(truth) > 0.9
    assert max(r["rank"] for r in got) == 5 and all(abs(r["cosine"] - unit[r["vec_id"]] @ unit[r["neighbour"]]) < 2e-3 for r in got[:500])


def test_unusable_vectors_and_small_dimensions(spark, rows):
    items = [(1, [1.0, 0.0], 2), (2, [2.0, 0.1], 2), (3, [0.0, 0.0], 2), (4, [1.0], 2), (5, None, 2), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [1.0, None], 2), (9, [1.0, 1.0, 1.0], 3), (None, [1.0, 0.0], 2), (10, [], 0), (11, [1.0], None)]
    near = nearest.nearest(vectors(spark, items))
    assert rows(near.select("vec_id", "rank", "neighbour")) == [(1, 1, 2), (2, 1, 1)]
    assert rows(nearest.neighbour_pairs(near)) == [(1, 2)]
    assert rows(nearest.nearest(vectors(spark, items[:0]))) == []


def test_copies_of_a_vector(spark):
    items = [(i, [1.0, 2.0, 3.0], 3) for i in range(3000)] + [(5000, [3.0, 1.0, 0.0], 3)]
    got = nearest.nearest(vectors(spark, items)).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("cosine").alias("c"), F.countDistinct("neighbour").alias("d")).collect()
    assert len(got) == 3001 and all(r["n"] == r["d"] == 5 for r in got) and sum(r["c"] > 0.999 for r in got) == 3000


def test_few_usable_vectors_among_many_rows(spark, rows):
    nulls = spark.range(200_000).select(F.col("id").alias("vec_id"), F.lit(None).cast("array<float>").alias("vectors"), F.lit(2).alias("dimension"))
    some = vectors(spark, [(500_000 + i, [1.0, 0.1 * i], 2) for i in range(2)])
    got = nearest.nearest(nulls.unionByName(some.select("vec_id", "vectors", "dimension")))
    assert rows(got.select("vec_id", "rank", "neighbour")) == [(500_000, 1, 500_001), (500_001, 1, 500_000)]


def test_copies_have_k_neighbours(spark):
    items = [(i, [1.0, 2.0, 3.0], 3) for i in range(500)]
    got = nearest.nearest(vectors(spark, items), k=8).groupBy("vec_id").agg(F.countDistinct("neighbour").alias("d")).collect()
    assert len(got) == 500 and all(r["d"] == 8 for r in got)


def test_near_copies_that_fill_a_bucket(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(24) + 0.01 * rng.standard_normal((36_000, 24)), rng.standard_normal((24_000, 24))]).astype(np.float32)
    ids = rng.permutation(len(x))
    data = spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "vectors": pa.array(list(x)), "dimension": pa.array(np.full(len(x), 24, np.int32))})).repartition(6)
    got = nearest.nearest(data).where(F.col("vec_id").isin(ids[:36_000:60].tolist())).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = set()
    for i in range(0, 36_000, 60):
        score = unit @ unit[i]
        score[i] = -9
        truth |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-score)[:5]}
    found = {(r["vec_id"], r["neighbour"]) for r in got}
    assert len(found) == len(truth)
    recall = len(truth & found) / len(truth)
    print(f"recall of near copies: {recall:.4f}")
    assert recall > 0.95


def recall_of(spark, x, asked, **how):
    """Share of the true neighbours of the asked rows that nearest() finds."""
    data = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "vectors": pa.array(list(x.astype(np.float32))), "dimension": pa.array(np.full(len(x), x.shape[1], np.int32))})).repartition(6)
    got = nearest.nearest(data, **how).where(F.col("vec_id").isin(list(map(int, asked)))).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -9
    truth = {(int(i), int(j)) for i, row in zip(asked, np.argsort(-score, axis=1)[:, :5]) for j in row}
    return len(truth & {(r["vec_id"], r["neighbour"]) for r in got}) / len(truth)


@pytest.mark.parametrize("d", [32, 64])
@pytest.mark.parametrize(("bucket", "bits"), [(512, 5), (8, 11)])
def test_many_bits_a_table(spark, d, bucket, bits):
    rng = np.random.default_rng(d)
    x = np.repeat(rng.standard_normal((2000, d)), 8, axis=0)
    x += 0.17 * rng.standard_normal(x.shape)  # neighbours at a cosine of about 0.97
    assert round(np.log2(len(x) / bucket)) == bits and bits * nearest.table_count(bits) > (d if bits == 11 else 0)
    assert recall_of(spark, x, np.arange(0, len(x), 20), bucket=bucket) >= 0.95


@pytest.mark.parametrize("d", [32, 64])
def test_bucket_of_fifty_blocks(spark, monkeypatch, d):
    monkeypatch.setattr(nearest, "BLOCK", (200, 200))
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.standard_normal(d) + 0.01 * rng.standard_normal((10_000, d)), rng.standard_normal((5_000, d))])
    assert recall_of(spark, x, np.arange(0, 10_000, 50)) >= 0.99


def test_more_bits_than_dimensions():
    x = np.random.default_rng(1).standard_normal((500, 6))
    mean, axes = nearest.learn_rotation(x, 15)
    assert axes.shape == (6, 15) and np.allclose(axes[:, 6:12].T @ axes[:, 6:12], np.eye(6), atol=1e-9)
    assert np.allclose(nearest.restored(nearest.shortened(x)), x / np.linalg.norm(x, axis=1)[:, None], atol=1e-6)


def pack(spark, sizes, capacity=100):
    data = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, size long")
    return packing.pack_sizes(data.repartition(3), capacity).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = [min(350, int(rng.lognormvariate(3.2, 1)) + 1) for _ in range(1500)] + [0, 100, 200, 250]
    got = pack(spark, sizes)
    fills, parts = {}, {}
    for r in got:
        fills[r["container_id"]] = fills.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start_token"], r["n_tokens"]))
    assert max(fills.values()) <= 100
    for i, n in enumerate(sizes):
        whole = sorted(parts.get(i, []))
        assert sum(p[2] for p in whole) == n
        assert len(whole) == -(-n // 100) and all(p[1] == 100 * k and p[0] == k for k, p in enumerate(whole))
    assert len(fills) <= 1.02 * sum(sizes) / 100 + 1


def test_packing_edges(spark):
    assert pack(spark, []) == []
    data = spark.createDataFrame([(1, "word " * 30), (2, None), (3, ""), (None, "x"), (1, "again")], "doc_id long, text string").withColumn("origin", F.lit(1)).withColumn("size", F.lit(2))
    got = packing.pack_documents(data, capacity=16).collect()
    assert {r["doc_id"] for r in got} == {1} and max(r["n_tokens"] for r in got) == 16
    assert packing.packing_report(packing.pack_documents(data, capacity=16), 16).first()["most"] == 16


def test_token_counts(spark):
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    texts = ["a lamp", "", None, "适合雨天骑行 <|endoftext|>", "x" * 200_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(tokens.count_tokens(F.col("t"))).collect()]
    assert got == [len(encode(t)) if t else 0 for t in texts]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000])
def test_permutations(size):
    index = np.arange(size)
    for key in (0, 7, 2**61):
        image = mixture.permuted(index, np.full(size, size), np.full(size, key))
        assert sorted(image) == list(range(size))
        assert (mixture.permuted(image, np.full(size, size), np.full(size, key), inverse=True) == index).all()


def corpus(spark, n=4000):
    rng = random.Random(8)
    names = ["Big_Source", "big-source ", "small", "tiny", None]
    rows = [(i, rng.choices(names, [6, 3, 1, 0.2, 0.3])[0], int(rng.lognormvariate(4, 1)) + 1) for i in range(n)]
    sizes = spark.createDataFrame(rows, "doc_id long, s string, n_tokens long")
    return sizes.select("doc_id", mixture.plain_source(F.col("s")).alias("source"), "n_tokens")


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix_id int, source string, target_share double, max_repeats int")


def test_mixing(spark):
    wanted = targets(spark, [(1, "big-source", 0.5, 1), (1, "Small ", 0.4, 3), (1, "tiny", 0.1, 4), (2, "tiny", 0.5, 2), (2, "nothing", 0.5, 2), (3, None, 1.0, 1), (4, "small", None, None)])
    made = mixture.lay_out(corpus(spark), wanted)
    parts = mixture.plan(made, wanted)
    report = {(r["mix_id"], r["source"]): r for r in mixture.share_report(made, parts).collect()}
    for (mix, source), want in {(1, "big-source"): 0.5, (1, "small"): 0.4, (1, "tiny"): 0.1, (2, "tiny"): 1.0, (2, "nothing"): 0.0}.items():
        assert report[mix, source]["share"] == pytest.approx(want, abs=0.01)
        assert (report[mix, source]["times_used"] or 0) <= report[mix, source]["max_repeats"]
    assert max(r["times_used"] / r["max_repeats"] for (m, _), r in report.items() if m == 1 and r["max_repeats"]) > 0.95
    checks = mixture.share_check(made, parts).collect()
    assert len(checks) == 6 and all(r["share_met"] and r["cap_kept"] and r["none_lost"] for r in checks)
    docs = mixture.mixed_documents(made, parts)
    counts = {(r["mix_id"], r["source"]): (r["low"], r["high"]) for r in docs.groupBy("mix_id", "source").agg(F.min("repeats").alias("low"), F.max("repeats").alias("high")).collect()}
    assert all(high - low <= 1 for low, high in counts.values())
    assert docs.where("mix_id = 1").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).join(made.docs.withColumnRenamed("n_tokens", "m"), "doc_id").where("n <> m").count() == 0


def test_blocks_agree_with_repeats(spark):
    wanted = targets(spark, [(1, "big-source", 0.6, 1), (1, "small", 0.4, 3)])
    made = mixture.lay_out(corpus(spark, 1500), wanted)
    parts = mixture.plan(made, wanted)
    blocks = mixture.mixed_blocks(made, parts).cache()
    assert blocks.count() == sum(p.drawn for p in parts)
    assert blocks.groupBy("source", "round", "block_no").count().where("count > 1").count() == 0
    assert all(r["n"] == mixture.BLOCK or r["block_no"] == r["last"] for r in blocks.groupBy("source", "block_no").agg(F.max("n_tokens").alias("n")).join(made.docs.groupBy("source").agg(F.floor((F.sum("n_tokens") - 1) / mixture.BLOCK).alias("last")), "source").collect())
    used = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert used == {r["source"]: r["tokens"] for r in mixture.share_report(made, parts).collect()}
    filled = mixture.filled_blocks(made, parts)
    by_doc = {r["doc_id"]: r["n"] for r in filled.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    planned = {r["doc_id"]: r["n"] for r in mixture.mixed_documents(made, parts).groupBy("doc_id").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect() if r["n"]}
    assert by_doc == planned
    whole = filled.groupBy("shard", "slot").agg(F.sum("n_tokens").alias("n"), F.max(F.col("at") + F.col("n_tokens")).alias("end")).join(blocks.select("shard", "slot", "n_tokens"), ["shard", "slot"])
    assert whole.count() == blocks.count() and whole.where("n <> n_tokens or end <> n_tokens").count() == 0


def test_shards_agree_on_their_draws():
    drawn = np.array([700, 20, 1, 0, 79], np.int64)
    shards = [mixture.shard_draw(drawn, 7, s, 3) for s in range(7)]
    assert (sum(t for _, t in shards) == drawn).all()
    for (used, taken), (following, _) in zip(shards, shards[1:]):
        assert (used + taken == following).all()
    assert {int(t.sum()) for _, t in shards} <= {114, 115}


def test_draws_of_any_size():
    drawn = np.array([60_000_000_000, 39_999_999_000, 1000, 0], np.int64)
    shards = -(-int(drawn.sum()) // mixture.SHARD_BLOCKS)
    for shard in (0, 1, shards // 2, shards - 1):
        used, taken = mixture.shard_draw(drawn, shards, shard, 3)
        assert 0 <= taken.sum() <= mixture.SHARD_BLOCKS + 1 and (taken >= 0).all() and (used + taken <= drawn).all()
        assert abs(taken[0] - 0.6 * taken.sum()) < 60
    used, taken = mixture.shard_draw(drawn, shards, shards - 1, 3)
    assert (used + taken == drawn).all()


def test_mixing_nothing(spark):
    wanted = targets(spark, [(1, "small", 1.0, 2)])
    made = mixture.lay_out(corpus(spark, 10).limit(0), wanted)
    parts = mixture.plan(made, wanted)
    assert mixture.mixed_documents(made, parts).count() == 0
    assert [r["tokens"] for r in mixture.share_report(made, parts).collect()] == [0]
    assert mixture.mixed_blocks(made, parts).count() == 0
    assert mixture.plan(made, targets(spark, [])) == []
