"""Baseline scores as arrays against a plain sum, whatever the blocks, the chunks and the ids."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import baseline, lexical
from quillstone.plans import QUERIES

TEXTS = [(f"d{i:02}", f"灯 泡 lamp{i % 3} " + "红 " * (i % 4) + ("锅" if i % 7 == 0 else "")) for i in range(40)] + [("d01", "锅 锅"), ("d02", None), ("none", ""), ("rare", "稀 灯")]
ASKED = [(1, "红 灯 lamp1"), (2, "锅 锅 锅"), (3, "红 红 红"), (4, "missing"), (5, None), (6, "lamp2 missing"), (7, "稀 灯 灯")]


def expected():
    docs, asked = {}, {}
    for name, text in TEXTS:
        docs.setdefault(name, Counter()).update((text or "").split())
    for number, text in ASKED:
        asked[number] = Counter((text or "").split())
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((len(TEXTS) + 1) / (n + 1)) + 1 for t, n in df.items()}
    raw = {(q, d): s for q, want in asked.items() for d, c in docs.items() if (s := sum(min(n, c[t]) * idf[t] for t, n in want.items() if c[t]))}
    best = {q: max(s for (x, _), s in raw.items() if x == q) for q, _ in raw}
    return {(q, d): math.floor(s / best[q] * 1e4 + 0.5) / 1e4 for (q, d), s in raw.items()}


@pytest.fixture
def made(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string").repartition(3)
    wanted = lexical.query_terms(spark.createDataFrame(ASKED, "query_id long, query string"), "query_id", X.tokenize(F.col("query")))
    return baseline.Baseline.build(docs, X.tokenize), wanted


@pytest.mark.parametrize("entries", [200_000, 3])
def test_scores_in_blocks_and_chunks(spark, made, monkeypatch, entries):
    monkeypatch.setattr(baseline, "ENTRIES", entries)
    index, wanted = made
    got = [tuple(r) for r in index.scores(wanted).select("query_id", "doc_id", "score").collect()]
    want = expected()
    assert len(got) == len(want) and {(q, d): s for q, d, s in got} == pytest.approx(want)
    pairs = spark.createDataFrame([(q, d) for q, _ in ASKED for d in ("d00", "d01", "none", "unknown")], "query_id long, doc_id string")
    some = {(r["query_id"], r["doc_id"]): r["table_score"] for r in index.scores_of(pairs, wanted).collect()}
    assert some == pytest.approx({k: s for k, s in want.items() if k[1] in ("d00", "d01", "none")})


def test_rerank_scores_its_candidates_alone(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("scores of all documents")

    monkeypatch.setattr(baseline.Baseline, "scores", whole)
    assert QUERIES["rerank_score_table_J7"](spark, "/root/testdata/sf0.001").count() > 0


def test_all_scores_are_not_shuffled(spark):
    plan = QUERIES["lexical_score_H1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scored = plan[: plan.index("Scan parquet")]  # from the result down to the blocks of documents
    assert "MapInArrow" in scored and "Exchange" not in scored and "Window" not in scored
