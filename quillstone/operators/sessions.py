"""Sessions: slots folded over turns, and context windows of bounded size."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X

IDS, OUT, LAST = (re.compile(p.removeprefix("(?i)"), re.IGNORECASE) for p in (X.PRODUCT_ID, X.EXCLUDED_ID, X.EXCLUDED_LAST))
WIDE = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]")


def slots(turns: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(session, turn, max_price, n_ids): after each turn, the last stated limit, and how many different ids were named so far.

    A new value replaces the old one, a turn without one inherits it. Turns are unique within a session.
    """
    so_far = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    ids = F.size(F.array_distinct(F.flatten(F.collect_list("__ids").over(so_far))))
    named = turns.withColumns({"__b": X.budget(F.col(text)), "__ids": X.product_ids(F.col(text))})
    return named.select(session, turn, F.last("__b", ignorenulls=True).over(so_far).alias("max_price"), ids.alias("n_ids"))


class Slots:
    """Session state of one session, turn by turn: ids seen, ids excluded (also 'not this one': the last seen then)."""

    def __init__(self, seen: Iterable[str] = (), excluded: Iterable[str] = ()) -> None:
        self.seen, self.excluded = list(seen), list(excluded)

    def take(self, text: str | None) -> None:
        text = text or ""
        out = OUT.findall(text) + ([self.seen[-1]] if LAST.search(text) and self.seen else [])
        self.excluded += [x for x in dict.fromkeys(out) if x not in self.excluded]
        self.seen += [x for x in dict.fromkeys(IDS.findall(text)) if x not in self.seen]


def fold_sessions(turns: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(session_id, turns, seen, excluded) after the last turn: a sequential fold, one session at a time in rows sorted by
    session and turn, so a session of any length is streamed through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, Slots(), 0
        done: list[tuple] = []
        for frame in batches:
            for s, t in zip(frame["session_id"], frame["text"]):
                if s != current:
                    if count:
                        done.append((current, count, state.seen, state.excluded))
                    current, state, count = s, Slots(), 0
                state.take(t)
                count += 1
            if done:
                yield pd.DataFrame(done, columns=["session_id", "turns", "seen", "excluded"])
                done = []
        if count:
            yield pd.DataFrame([(current, count, state.seen, state.excluded)], columns=["session_id", "turns", "seen", "excluded"])

    rows = turns.select(F.col(session).cast("string").alias("session_id"), F.col(turn).alias("turn"), F.col(text).alias("text")).where("session_id is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "turn").select("session_id", "text").mapInPandas(run, "session_id string, turns long, seen array<string>, excluded array<string>")


def estimate(text: str) -> int:
    """Tokens of a text: a wide character is one, four others are one."""
    wide = len(WIDE.findall(text))
    return wide + (len(text) - wide + 3) // 4


def compress(turns: list[str], usable: int, keep: int = 6, head: str = "") -> tuple[list[str], list[str], int]:
    """(kept turns, summaries, tokens) of at most usable tokens with the head.

    If all turns fit, all are kept. Else the latest ones are, up to keep, as far as they fit; what room is left goes to
    the first characters of the turns before them, latest first. A last turn that doesn't fit alone is cut to what does.
    """
    room = max(0, usable - estimate(head))
    costs = [estimate(t) for t in turns]
    if sum(costs) <= room:
        return list(turns), [], sum(costs) + estimate(head)
    fits = list(takewhile(lambda used: used <= room, accumulate(reversed(costs))))[:keep]
    if not fits and turns:
        last = turns[-1]
        size = bisect_right(range(len(last) + 1), room, key=lambda n: estimate(last[:n] + "…")) - 1
        kept = [last[:size] + "…"] if size > 0 else []
    else:
        kept = list(turns[len(turns) - len(fits) :])
    left = room - sum(map(estimate, kept))
    openings = [t[:60] for t in reversed(turns[: len(turns) - max(1, len(fits))])]
    few = bisect_right(range(len(openings) + 1), left, key=lambda n: estimate(" ".join(openings[:n]))) - 1
    summaries = openings[: max(0, few)][::-1]
    return kept, summaries, estimate(head) + estimate(" ".join(summaries)) + sum(map(estimate, kept))


def context_windows(turns: DataFrame, usable: int, keep: int = 6, session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(session_id, kept, dropped, tokens, original_tokens) of each session's window after its last turn.

    Only the last turns matter: those whose tokens, summed from the end, reach usable. Earlier ones are folded without being read.
    """
    back = Window.partitionBy(session).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, -1)
    sized = turns.where(F.col(session).isNotNull()).withColumn("__t", X.estimate_tokens(F.col(text)))
    marked = sized.withColumn("__after", F.coalesce(F.sum("__t").over(back), F.lit(0)))
    near = F.when(F.col("__after") <= usable, F.struct(F.col(turn).alias("turn"), F.coalesce(text, F.lit("")).alias("text")))
    grouped = marked.groupBy(F.col(session).cast("string").alias("session_id")).agg(F.transform(F.sort_array(F.collect_list(near)), lambda x: x["text"]).alias("texts"), F.count(F.lit(1)).alias("n"), F.sum("__t").alias("original_tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            made = [compress(list(t), usable, keep) for t in frame["texts"]]
            yield pd.DataFrame({"session_id": frame["session_id"], "kept": [len(k) for k, _, _ in made], "dropped": frame["n"] - [len(k) for k, _, _ in made], "tokens": [t for *_, t in made], "original_tokens": frame["original_tokens"]})

    return grouped.mapInPandas(run, "session_id string, kept long, dropped long, tokens long, original_tokens long")


def window_statistics(windows: DataFrame, usable: int) -> DataFrame:
    """Adds ratio (tokens kept over tokens before, 4 decimals; 1 if there were none), compressed, and over (whether the window is too large)."""
    ratio = F.round(F.coalesce(F.try_divide("tokens", "original_tokens"), F.lit(1.0)), 4)
    return windows.withColumns({"ratio": ratio, "compressed": F.col("tokens") < F.col("original_tokens"), "over": F.col("tokens") > usable})


def over_budget(head: Column, last_turn: Column, usable: int) -> Column:
    """Whether a head and the last turn alone take more tokens than there are."""
    return X.estimate_tokens(head) + X.estimate_tokens(last_turn) > usable


def versioned_save(store: DataFrame, updates: DataFrame, key: str = "session_id") -> DataFrame:
    """The store(key, version, …) after updates(key, read_version, …): an update counts only if the stored version is the
    one that was read; of several that do, the smallest by all columns. New keys were read as version 0."""
    rest = [c for c in store.columns if c not in (key, "version")]
    held = store.select(F.col(key), F.col("version").alias("__held"))
    fits = updates.join(held, key, "left").where(F.col("read_version") == F.coalesce("__held", F.lit(0)))
    one = fits.groupBy(key).agg(F.min(F.struct("read_version", *rest)).alias("u"))
    both = store.join(one, key, "full_outer")
    value = lambda c: F.when(F.col("u").isNotNull(), F.col("u")[c]).otherwise(store[c]).alias(c)
    return both.select(key, F.when(F.col("u").isNotNull(), F.col("u.read_version") + 1).otherwise(store["version"]).alias("version"), *map(value, rest))


def digest(max_price: Column, category: Column, seen: Column) -> Column:
    """A one-line summary of a session's slots."""
    parts = F.concat_ws("；", F.when(max_price.isNotNull(), F.concat(F.lit("预算上限 ¥"), F.format_string("%.0f", max_price))), F.concat(F.lit("类目 "), category), F.when(F.size(seen) > 0, F.concat(F.lit("已提及商品 "), F.array_join(F.slice(seen, F.greatest(F.size(seen) - 7, F.lit(1)), F.lit(8)), "、"))))
    return F.when(parts == "", "[会话状态] 尚无已确认约束。").otherwise(F.concat(F.lit("[会话状态] "), parts, F.lit("。")))
