"""Languages of texts and of the stretches of mixed texts, by character language models.

For each language an interpolated Kneser-Ney model of character n-grams is trained on a bounded sample of labelled rows.
Labels may be wrong, and a model learns a language well from the few sentences of it that stand under a wrong label. So
each n-gram of the sample first votes for the labels that it occurs under, by share, and sentences whose n-grams vote
for another label aren't trained on. All models share sorted arrays of n-gram hashes, one for each order, with a column for each language.
A text is cut into sentences, names, codes and figures aside; a sentence gets the language of the lowest cross-entropy
per character, and none if that is hardly lower than for another language, or is higher than the model's own held-out sentences reach
and not far lower than for all others (calibrated rejection). Its confidence is the softmax of the cross-entropies at the
temperature that fits held-out stretches of different lengths best, so that a share of about c of the answers with confidence c is right.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.lookalike import canonical
from quillstone.llm.spans import mixed

LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "zh")
#: Labelled rows of each language, about, that models are trained on.
SAMPLE = 500
ORDER = 4
#: Size of the alphabet that unseen characters share.
ALPHABET = 30_000
#: Of held-out sentences of the right language, how many may be rejected; and slack beyond that.
REJECTED, SLACK = 0.0005, 1.15
#: The code of texts without a language (ISO 639: undetermined).
UNKNOWN = "und"
#: Below UNSURE (names alone, say) a sentence has no language; above the limit of its model, it needs a confidence of SURE.
UNSURE, SURE = 0.6, 0.99
#: Lengths of the held-out stretches that confidence is calibrated on.
STRETCHES = (3, 5, 8, 12, 20, 40)
START = "\x02" * (ORDER - 1)

CODES = re.compile(r"(?<![A-Za-zÀ-ɏ\-_.])[A-Za-zÀ-ɏ\-_.]*+\d[A-Za-zÀ-ɏ\d]*+(?:[\-_.,:/]?[A-Za-zÀ-ɏ]*+\d[A-Za-zÀ-ɏ\d]*+)*+|\d+")
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|[\n\r]+|\s+[/—|·–]+\s+|\s*[｜]\s*|\s*\|\s*")
NAMES = re.compile(r"[A-Za-zÀ-ɏ]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W\d_]{3,}|[぀-ヿ㐀-鿿]{2,}")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that have words, in lower case, without codes and figures, nor Latin names in CJK ones."""
    if not text:
        return []
    parts = SENTENCES.split(CODES.sub(" ", _kept_stops(text)))
    return [" ".join(_inner(NAMES.sub(" ", p) if len(CJK.findall(p)) >= 4 else p).lower().split()) for p in parts if p and WORD.search(p)]


def _inner(text: str) -> str:
    """Without signs at the ends."""
    first = next((i for i, x in enumerate(text) if x.isalnum()), len(text))
    last = next((i for i in range(len(text), first, -1) if text[i - 1].isalnum()), first)
    return text[first:last]


def _kept_stops(text: str) -> str:
    """The look-alike form, with line ends kept as they end sentences."""
    if "\n" in text or "\r" in text:
        return "\n".join(canonical(x) for x in text.splitlines())
    return canonical(text)


def keyed(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(offsets, for n = 0 to ORDER: hashes of the n-grams that end at each character, and of their first n - 1 characters)."""
    joined = START + START.join(texts) if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.append(0, np.cumsum(lengths))
    at = np.arange(offsets[-1]) + np.repeat((np.arange(len(texts)) + 1) * len(START), lengths)
    h = mixed(points)
    total, hashes = h.copy(), [np.zeros(len(h), np.uint64), mixed(h)]
    for n in range(2, ORDER + 1):
        total[n - 1 :] += h[: len(h) - n + 1] * np.uint64(pow(0x9E3779B97F4A7C15, n - 1, 1 << 64))
        hashes.append(mixed(total))
    return offsets, [x[at] for x in hashes], [np.zeros(0, np.uint64), *(x[at - 1] for x in hashes[:-1])]


@dataclass
class Models:
    """grams[n]: sorted n-gram hashes; found[n]: their log-probabilities by language (NaN: unseen there); contexts and
    backoff likewise, for the n - 1 characters before; limit: of rejection; sharpness: of the reported confidence."""

    grams: list[np.ndarray]
    found: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    limit: np.ndarray
    sharpness: float = 1.0

    def score(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character, for each text (none empty) and language."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        offsets, keys, before = keyed(texts)
        back, grams = pd.factorize(keys[ORDER])  # each n-gram is looked up once
        first = np.empty(len(grams), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
        log = np.full((len(first), len(LANGUAGES)), -np.log(ALPHABET), np.float32)
        for n in range(1, ORDER + 1):
            weight, known = _look_up(self.contexts[n], self.backoff[n], before[n][first])
            log += np.where(known, weight, 0)
            value, known = _look_up(self.grams[n], self.found[n], keys[n][first])
            log = np.where(known, value, log)
        return -np.add.reduceat(log[back], offsets[:-1], axis=0) / np.diff(offsets)[:, None]

    def choose(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none) and confidence of each text."""
        entropy = self.score(texts)
        best = entropy.argmin(axis=1) if len(texts) else np.zeros(0, np.int64)
        lowest = entropy[np.arange(len(best)), best]
        lead = _lead(entropy, texts)
        sure = 1 / np.exp(-lead).sum(axis=1)
        said = (sure >= UNSURE) & ((lowest <= self.limit[best]) | (sure >= SURE))
        return np.where(said, best, -1), 1 / np.exp(-self.sharpness * lead).sum(axis=1)


def _lead(entropy: np.ndarray, texts: list[str]) -> np.ndarray:
    """How far each language is behind the best one. Characters of a text depend on each other; their number counts by its root."""
    return (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.fromiter(map(len, texts), np.float64, len(texts)))[:, None]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    value = values[at]
    return value, (keys[at] == wanted)[:, None] & ~np.isnan(value)


def _kneser_ney(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each order: n-gram hashes, log-probabilities, context hashes, log backoff weights."""
    _, keys, before = keyed(texts)
    out: list[tuple[np.ndarray, ...]] = [()]
    lower = np.full(len(keys[0]), 1 / ALPHABET)
    for n in range(1, ORDER + 1):
        if n == ORDER:
            gram, first, count = np.unique(keys[n], return_index=True, return_counts=True)
        else:  # in how many contexts an n-gram occurs, not how often
            _, one = np.unique(keys[n + 1], return_index=True)
            gram, first, count = np.unique(keys[n][one], return_index=True, return_counts=True)
            first = one[first]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        context, number = np.unique(before[n][first], return_inverse=True)
        total = np.bincount(number, count)
        weight = discount * np.bincount(number) / total
        chance = np.maximum(count - discount, 0) / total[number] + weight[number] * lower[first]
        out.append((gram, np.log(chance), context, np.log(weight)))
        here = np.minimum(np.searchsorted(gram, keys[n]), len(gram) - 1)
        lower = np.where(gram[here] == keys[n], chance[here], lower)
    return out


def _shared(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    table = np.full((len(keys), len(parts)), np.nan, np.float32)
    for i, (k, v) in enumerate(parts):
        table[np.searchsorted(keys, k), i] = v
    return keys, table


def _fit(texts: list[list[str]]) -> Models:
    orders = [_kneser_ney(t or [" "]) for t in texts]
    grams, found, contexts, backoff = ([np.zeros(0)] for _ in range(4))
    for n in range(1, ORDER + 1):
        k, v = _shared([o[n][:2] for o in orders])
        c, w = _shared([o[n][2:] for o in orders])
        for to, x in zip((grams, found, contexts, backoff), (k, v, c, w)):
            to.append(x)
    return Models(grams, found, contexts, backoff, np.full(len(texts), np.inf))


def _votes(texts: list[str], label: np.ndarray) -> np.ndarray:
    """The label that most n-grams of each text stand for; an n-gram divides its vote by how often each label has it."""
    if not texts:
        return label
    offsets, keys, _ = keyed(texts)
    _, gram = np.unique(keys[ORDER], return_inverse=True)
    counts = np.bincount(gram * len(LANGUAGES) + np.repeat(label, np.diff(offsets)), minlength=(gram.max() + 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.add.reduceat(share[gram], offsets[:-1], axis=0).argmax(axis=1)


def train(labelled: list[tuple[str, str]]) -> Models:
    """Models from (label, text) rows with some wrong labels; a tenth of the sentences is held out to set the limits."""
    pools: list[list[str]] = [[] for _ in LANGUAGES]
    for label, text in sorted(labelled):
        pools[LANGUAGES.index(label)] += sentences(text)
    pool = [s for p in pools for s in p]
    label = np.repeat(np.arange(len(pools)), list(map(len, pools)))
    mine = _votes(pool, label) == label
    clean = [[pool[i] for i in np.flatnonzero(mine & (label == x))] for x in range(len(pools))]
    judge = _fit([[s for j, s in enumerate(p) if j % 10] for p in clean])
    models = _fit(clean)
    for i, p in enumerate(clean):
        if len(p) >= 20:
            models.limit[i] = np.quantile(judge.score(p[::10])[:, i], 1 - REJECTED) * SLACK
    held = [(i, s[:n]) for i, p in enumerate(clean) for s in p[::10] for n in STRETCHES if len(s) >= n]
    if held:
        models.sharpness = fit_sharpness(judge, np.array([i for i, _ in held]), [x for _, x in held])
    return models


def fit_sharpness(models: Models, label: np.ndarray, texts: list[str]) -> float:
    """The factor on the lead that makes the labels likeliest."""
    lead = _lead(models.score(texts), texts)
    tried = 2.0 ** np.arange(-3, 4.01, 0.25)
    lost = [np.mean(t * lead[np.arange(len(label)), label] + np.log(np.exp(-t * lead).sum(axis=1))) for t in tried]
    return float(tried[int(np.argmin(lost))])


def reliability(confidence: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """The expected calibration error: how far mean confidence and share of right answers are apart, over bins of equal width."""
    of = np.minimum((confidence * bins).astype(int), bins - 1)
    return float(sum(abs(confidence[of == b].mean() - right[of == b].mean()) * (of == b).mean() for b in np.unique(of)))


def plain_label(label: Column) -> Column:
    """The label's language in lower case, without region or script; null if it names none of LANGUAGES."""
    code = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*\s*$", 1))
    return F.when(code.isin(*LANGUAGES), code)


def sample_labelled(rows: DataFrame, labels: DataFrame, fields: list[str]) -> list[tuple[str, str]]:
    """About SAMPLE labelled rows of each language: their label and each text. The sample's size is the same for any input."""
    named = labels.select(F.col("product_id").alias("__id"), plain_label(F.col("lang_label")).alias("__label")).where("__id is not null and __label is not null")
    counts = {r["__label"]: r["count"] for r in named.groupBy("__label").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE / n))))
    chosen = named.where(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 20)) < share[F.col("__label")] * (1 << 20))
    texts = rows.select(F.col("id").alias("__id"), F.array(*fields).alias("texts"))
    found = texts.join(F.broadcast(chosen), "__id").select("__label", "texts")
    return [(r["__label"], t) for r in found.collect() for t in r["texts"] if t]


def _sentences_of(batch: pa.RecordBatch, fields: int) -> tuple[np.ndarray, list[str]]:
    """(owner, sentence): the sentences of all fields; the owner is field x rows + row."""
    owner, texts = [], []
    for f in range(fields):
        for i, text in enumerate(batch.column(1 + f).to_pylist()):
            found = sentences(text)
            owner += [f * batch.num_rows + i] * len(found)
            texts += found
    return np.array(owner, np.int64), texts


def _segmenter(models, fields: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            owner, texts = _sentences_of(batch, len(fields))
            language, confidence = models.value.choose(texts)
            said = language >= 0
            own, language, confidence = owner[said], language[said], confidence[said]
            size = np.fromiter(map(len, texts), np.int64, len(texts))[said]
            if not len(own):
                continue
            begins = np.append(True, (np.diff(own) != 0) | (np.diff(language) != 0))
            at = np.flatnonzero(begins)
            field_start = np.append(True, np.diff(own[at]) != 0)
            number = np.arange(len(at)) - np.maximum.accumulate(np.where(field_start, np.arange(len(at)), 0)) + 1
            weight = np.add.reduceat(size, at)
            fields_at = np.flatnonzero(field_start)
            of = np.diff(np.append(fields_at, len(at)))
            yield pa.record_batch(
                [
                    pa.array([ids[o % len(ids)] for o in own[at]], pa.string()),
                    pa.array([fields[o // len(ids)] for o in own[at]]),
                    pa.array(number.astype(np.int32)),
                    pa.array([LANGUAGES[x] for x in language[at]]),
                    pa.array(np.add.reduceat(confidence * size, at) / weight),
                    pa.array(weight.astype(np.int32)),
                    pa.array(np.repeat(of, of).astype(np.int32)),
                ],
                names=["product_id", "field_name", "segment_no", "lang", "confidence", "n_chars", "n_segments"],
            )

    return run


def segments(rows: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """(product_id, field_name, segment_no, lang, confidence, n_chars, n_segments): the language segments of each text field.

    A segment is a longest run of sentences in one language; sentences without words, or in no known language, belong to
    the segment around them. Null texts and texts without words have no segment; rows with a null id are left out;
    repeated rows give their segments again. confidence is the mean over the segment's characters.
    """
    models = rows.sparkSession.sparkContext.broadcast(train(sample_labelled(rows, labels, fields)))
    return rows.where("id is not null").select("id", *fields).mapInArrow(_segmenter(models, fields), "product_id string, field_name string, segment_no int, lang string, confidence double, n_chars int, n_segments int")


def _judge(models, fields: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(fields) * batch.num_rows
            if not n:
                continue
            owner, texts = _sentences_of(batch, len(fields))
            language, confidence = models.value.choose(texts)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            weight, trust = np.zeros((n, len(LANGUAGES) + 1), np.int64), np.zeros((n, len(LANGUAGES) + 1))
            np.add.at(weight, (owner, language), size)  # -1, no language, is the last column
            np.add.at(trust, (owner, language), size * confidence)
            best = weight[:, :-1].argmax(axis=1)
            most, total = weight[np.arange(n), best], weight.sum(axis=1)
            said = most > 0
            part = np.divide(most, total, out=np.zeros(n), where=said)
            sure = np.divide(trust[np.arange(n), best], most, out=np.zeros(n), where=said)
            yield pa.record_batch(
                [
                    pa.array(batch.column(0).to_pylist() * len(fields), pa.string()),
                    pa.array(np.repeat(fields, batch.num_rows)),
                    pa.array([LANGUAGES[b] if y else UNKNOWN for b, y in zip(best, said)]),
                    pa.array(sure),
                    pa.array(part),
                    pa.array((weight[:, :-1] > 0).sum(axis=1).astype(np.int32)),
                    pa.array(total),
                    pa.array(weight[:, -1]),
                ],
                names=["product_id", "field_name", "lang", "confidence", "share", "n_langs", "n_chars", "unknown_chars"],
            )

    return run


def document_languages(rows: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """(product_id, field_name, lang, confidence, share, n_langs, n_chars, unknown_chars): one row for each field of each row.

    lang is that of most characters, UNKNOWN with confidence 0 if the text is null, has no words, or all its sentences are
    rejected; share is its part of the characters of all sentences, of which unknown_chars lie in rejected ones.
    """
    models = rows.sparkSession.sparkContext.broadcast(train(sample_labelled(rows, labels, fields)))
    schema = "product_id string, field_name string, lang string, confidence double, share double, n_langs int, n_chars long, unknown_chars long"
    return rows.select("id", *fields).mapInArrow(_judge(models, fields), schema)


def mislabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments of the fields that are anything other than one segment in the labelled language."""
    named = labels.where("product_id is not null").select("product_id", plain_label(F.col("lang_label")).alias("label")).where("label is not null").dropDuplicates(["product_id"])
    return found.join(named, "product_id", "left").where("not (n_segments = 1 and lang <=> label)").drop("label")
