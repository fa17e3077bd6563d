"""Expressions over nested records: hits, traces, payloads and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of a hit's reasons, and the prefix of a session's key.
TEXT_REASON, IMAGE_REASON, PRICE_REASON = "商品文本与需求匹配", "商品图片视觉特征相似", "价格不超过 ¥"
KEY_PREFIX, OPEN_PRINCIPAL = "auth:v1:", "demo"


def rendered(value: Column, kind: T.DataType) -> Column:
    """A stable text: '' for a null, a text as it is, the items of an array in lines, and JSON with sorted keys for anything else."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(value, lambda x: rendered(x, kind.elementType)), "\n"), F.lit(""))
    if isinstance(kind, T.StructType):
        value = F.when(value.isNotNull(), F.struct(*(value[name].alias(name) for name in sorted(kind.names))))
    if isinstance(kind, T.MapType):
        value = F.map_from_entries(F.array_sort(F.map_entries(value)))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def payload_ids(items: Column) -> Column:
    """The product ids of items(product.id, product_id, id): the first that there is and isn't empty, each id once, in order."""
    filled = lambda c: F.nullif(c, F.lit(""))
    ids = F.transform(items, lambda x: F.coalesce(filled(x["product"]["id"]), filled(x["product_id"]), filled(x["id"])))
    return F.coalesce(F.array_distinct(F.array_compact(ids)), F.array().cast("array<string>"))


def candidates(hits: Column, limit: int = 3) -> Column:
    """Up to limit flat candidates (product_id, title, category, price, rating, stock, score, reasons) of hits(product, score, reasons)
    that name a product."""
    names = ("title", "category", "price", "rating", "stock")
    flat = F.transform(hits, lambda h: F.struct(h["product"]["id"].alias("product_id"), *(h["product"][n].alias(n) for n in names), h["score"].alias("score"), h["reasons"].alias("reasons")))
    return F.slice(F.filter(flat, lambda c: F.coalesce(c["product_id"], F.lit("")) != ""), 1, limit)


def public_trace(trace: Column) -> Column:
    """Of trace(tool, ok, …), what may be shown: the tool and whether it worked."""
    return F.transform(trace, lambda t: F.struct(t["tool"].alias("tool"), t["ok"].alias("ok")))


def plain_number(x: Column) -> Column:
    """A number with up to six decimals, without trailing zeros; null stays null."""
    short = F.when(x.isNotNull(), F.format_string("%.6f", x))
    return F.regexp_replace(F.regexp_replace(short, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def reasons(text_score: Column, image_score: Column, max_price: Column) -> Column:
    """Why a hit was found, one label for each route that found it and for the price limit."""
    return F.array_compact(F.array(F.when(text_score > 0, TEXT_REASON), F.when(image_score > 0, IMAGE_REASON), F.concat(F.lit(PRICE_REASON), plain_number(max_price))))


def session_key(principal: Column, session: Column) -> Column:
    """A key that hides both names; the open principal's sessions keep their own. Null if either is."""
    pair = F.concat(F.lit("["), F.to_json(F.array(principal)).substr(F.lit(2), F.length(F.to_json(F.array(principal))) - 2), F.lit(", "), F.to_json(F.array(session)).substr(F.lit(2), F.length(F.to_json(F.array(session))) - 2), F.lit("]"))
    return F.when(principal == OPEN_PRINCIPAL, session).when(principal.isNotNull() & session.isNotNull(), F.concat(F.lit(KEY_PREFIX), F.sha2(pair, 256)))


def parsed_queries(answer: Column, expected: Column) -> Column:
    """The queries of a JSON answer {"queries": [{"index": 0, "query": "…"}, …]} in the order of their indexes; null if one of the expected
    indexes is missing. Items that aren't objects, or lack a valid index or a text, are skipped; of a repeated index the last counts."""
    items = F.filter(F.from_json(F.get_json_object(answer, "$.queries"), "array<string>"), lambda x: x.startswith("{"))
    read = F.transform(items, lambda x: F.struct(F.get_json_object(x, "$.index").cast("int").alias("index"), F.trim(F.get_json_object(x, "$.query")).alias("query")))
    good = F.filter(read, lambda x: x["index"].isNotNull() & (x["index"] >= 0) & (x["index"] < expected) & (x["query"] != ""))
    last = F.transform(F.sequence(F.lit(0), F.greatest(expected, F.lit(1)) - 1), lambda i: F.try_element_at(F.transform(F.filter(good, lambda x: x["index"] == i), lambda x: x["query"]), F.lit(-1)))
    return F.when(F.forall(last, lambda q: q.isNotNull()), last)
