"""Text expressions: tokens, documents, planner patterns, stable renderings. All are built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that results depend on.
TOKEN = r"[一-鿿]|[a-z0-9]+"
LATIN_TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
CJK = r"[一-鿿]"
WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
COMPARE_WORDS = ("对比", "比较", "区别")
INVENTORY_WORDS = ("库存", "有货", "现货")
BUDGETS = (r"(\d+(?:\.\d+)?)\s*元\s*(?:以内|以下|之内)", r"预算\s*(?:为|是|不超过|低于)?\s*(\d+(?:\.\d+)?)", r"(?:不超过|低于|小于)\s*(\d+(?:\.\d+)?)\s*元?")
PRODUCT_ID = r"(?i)\b([a-z][a-z0-9]*-\d{2,})\b"
EXCLUDED_ID = r"(?i)(?:不要|不用|别|排除|除了)\s*([a-z][a-z0-9]*-\d{2,})"
EXCLUDED_LAST = r"(?:不要|不用|别|排除)\s*(?:这个|那款|这款)"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Single Han characters and Latin runs, lower case; empty for a null."""
    return F.coalesce(found(F.lower(text), TOKEN), F.array().cast("array<string>"))


def analyze(text: Column) -> Column:
    """Terms for ranking: Latin runs with inner dots and hyphens, Han characters, and pairs of consecutive Han characters
    (across whatever stands between them); empty for a null."""
    low = F.lower(text)

    def with_pairs(chars: Column) -> Column:
        n = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.concat(chars, F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b)))

    # The one-element array binds the characters to a name, so that the pattern runs once.
    han = F.get(F.transform(F.array(found(low, CJK)), with_pairs), F.lit(0))
    return F.coalesce(F.concat(found(low, LATIN_TERM), han), F.array().cast("array<string>"))


def attribute_text(attributes: Column) -> Column:
    """'key value' of each entry in the map's order; '' for a null map."""
    return F.coalesce(F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "), F.lit(""))


def searchable_text(title: Column, category: Column, description: Column, attributes: Column) -> Column:
    """The text that lexical search sees."""
    return F.lower(F.concat_ws(" ", title, category, description, F.nullif(attribute_text(attributes), F.lit(""))))


def product_document(title: Column, category: Column, description: Column, attributes: Column) -> Column:
    """The text that a reranker reads: title and category as sentences of their own, then the rest."""
    body = F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(attribute_text(attributes), F.lit("")))
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("。"), F.coalesce(category, F.lit("")), F.lit("。"), body))


def strip_html(text: Column, limit: int = 4000) -> Column:
    """Tags become spaces, ends are trimmed, and at most limit characters stay."""
    return F.substring(strip(F.regexp_replace(text, "<[^>]+>", " ")), 1, limit)


def estimate_tokens(text: Column) -> Column:
    """A wide character counts as one token, four others as one; 0 for a null."""
    rest = F.length(F.regexp_replace(text, WIDE, ""))
    return F.coalesce(F.length(text) - rest + F.floor((rest + 3) / 4), F.lit(0)).cast("long")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the SHA-256, modulo buckets."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets


def stable_split(key: Column) -> Column:
    """80 % train, 10 % validation, 10 % test, by the key alone."""
    bucket = hash_bucket(key)
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").when(bucket.isNotNull(), "test")


def plain_split(split: Column) -> Column:
    """train, validation or test without case, padding and other names of validation; null if not assigned or unknown."""
    name = F.lower(strip(split))
    return F.when(name.isin("val", "valid", "dev", "validation"), "validation").when(name.isin("train", "test"), name)


def plain_hash(content: Column) -> Column:
    """A hexadecimal hash without case, padding or the name of its algorithm; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(strip(content)), r"^sha256:\s*", ""), F.lit(""))


def localized_pick(values: Column, languages: list[str]) -> Column:
    """The first non-empty value in the order of languages, else the first non-empty one, else ''."""
    filled = F.filter(values, lambda v: F.coalesce(v["value"], F.lit("")) != "")
    first = lambda a: F.get(a, F.lit(0))["value"]
    of = lambda tag: F.filter(filled, lambda v: v["language_tag"] == tag)
    return F.coalesce(*(first(of(tag)) for tag in languages), first(filled), F.lit(""))


def localized_join(values: Column, languages: list[str]) -> Column:
    """All non-empty values in one of the languages, joined; if there are none, localized_pick()."""
    chosen = F.filter(values, lambda v: (F.coalesce(v["value"], F.lit("")) != "") & v["language_tag"].isin(*languages))
    return F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, lambda v: v["value"]), " ")).otherwise(localized_pick(values, languages))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def intent(text: Column, requested: Column) -> Column:
    """The requested intent, unless it is null or 'auto': then by the words of the text."""
    by_words = F.when(_any(text, COMPARE_WORDS), "compare").when(_any(text, INVENTORY_WORDS), "inventory").otherwise("search")
    return F.when(requested.isNotNull() & (requested != "auto"), requested).otherwise(by_words)


def budget(text: Column) -> Column:
    """The upper limit that a text states; the first pattern that matches counts."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in BUDGETS)).cast("double")


def product_ids(text: Column) -> Column:
    """Ids like shoe-001 in a text, each once, in order; empty for a null."""
    return F.coalesce(F.array_distinct(found(text, PRODUCT_ID, 1)), F.array().cast("array<string>"))


def excluded_ids(text: Column) -> Column:
    """Ids that a text rules out."""
    return F.coalesce(F.array_distinct(found(text, EXCLUDED_ID, 1)), F.array().cast("array<string>"))


def excludes_last(text: Column) -> Column:
    """Whether a text rules out what was mentioned last."""
    return F.coalesce(F.regexp_like(text, F.lit(EXCLUDED_LAST)), F.lit(False))


def idempotency_key(tool: Column, arguments: Column) -> Column:
    """32 hexadecimal digits of the hash of a call; arguments is a struct whose fields stand in order."""
    return F.substring(F.sha2(F.concat_ws("|", tool, F.to_json(arguments)), 256), 1, 32)


def attribute_question(attributes: Column, category: Column) -> Column:
    """A question for the first three non-empty attribute values; null if there are none."""
    values = F.filter(F.map_values(attributes), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(values) > 0, F.concat(F.lit("想找一款"), F.array_join(F.slice(values, 1, 3), "、"), F.lit("的"), category, F.lit("，请推荐符合这些属性的商品")))


def point_question(key: Column) -> Column:
    """A question for one product."""
    return F.concat(F.lit("找一款 "), key, F.lit(" 同款商品"))
