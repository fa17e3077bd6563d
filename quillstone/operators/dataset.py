"""Preparing catalogs: validation, deduplication by content, splits, and conversion of public listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X


def violations(rows: DataFrame, key: str = "id", required: list[str] = ("source", "license"), at_least_zero: list[str] = ("price", "stock")) -> DataFrame:
    """(id, problem) for each breach: a missing or repeated id, a missing required value, a negative number."""
    repeated = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("id"), F.lit("repeated id").alias("problem"))
    problems = F.array_compact(F.array(F.when(F.col(key).isNull(), "no id"), *(F.when(X.strip(F.coalesce(F.col(c), F.lit(""))) == "", f"no {c}") for c in required), *(F.when(F.col(c) < 0, f"negative {c}") for c in at_least_zero)))
    return rows.select(F.col(key).alias("id"), F.explode(problems).alias("problem")).unionByName(repeated)


def validate(rows: DataFrame, **options) -> DataFrame:
    """rows, or an error that names the first problems."""
    bad = violations(rows, **options).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return rows


def canonical_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Adds canonical (the smallest key with the same content) and copies (how many rows share it); a null content is its own.

    Counts are taken before the shuffle and joined back, so a content that many rows share is no hot group.
    """
    hashed = F.sha2(F.col(content), 256)
    groups = rows.where(F.col(content).isNotNull()).groupBy(hashed.alias("__h")).agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))
    joined = rows.join(groups, hashed == F.col("__h"), "left").drop("__h")
    return joined.withColumns({"canonical": F.coalesce("canonical", key), "copies": F.coalesce("copies", F.lit(1))})


def summary(rows: DataFrame, key: str, image: str, split: str) -> DataFrame:
    """One row: products, different images, repeated images, and rows of each split (0 where there are none); splits and
    hashes in their plain forms."""
    part = lambda s: F.count_if(F.col(split) == s).alias(s)
    rows = rows.withColumns({split: X.plain_split(F.col(split)), image: X.plain_hash(F.col(image))})
    return rows.agg(F.count(F.lit(1)).alias("products"), F.countDistinct(image).alias("images"), (F.count(image) - F.countDistinct(image)).alias("repeated_images"), part("train"), part("validation"), part("test"))


def prepare(raw: DataFrame) -> DataFrame:
    """Checked raw rows with a stable split by id."""
    return validate(raw).withColumn("split", X.stable_split(F.col("id")))


def of_split(rows: DataFrame, wanted: str, split: str = "split") -> DataFrame:
    """The rows of a split, by its plain name."""
    return rows.where(X.plain_split(F.col(split)) == wanted)


def resolvable_images(rows: DataFrame, files: DataFrame, image: str = "image_path") -> DataFrame:
    """One row (rows, named, resolvable): how many rows name an image, and how many of those images are among files(path)."""
    there = files.select(F.col("path").alias("__p")).where("__p is not null").distinct()
    return rows.join(there, F.col(image) == F.col("__p"), "left").agg(F.count(F.lit(1)).alias("rows"), F.count(image).alias("named"), F.count("__p").alias("resolvable"))


def alignment(catalog: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(problem, n) of a benchmark's tables that don't fit together; empty if they do.

    catalog(id), vectors(id, vector), queries(product_id, query, vector): products without a vector, vectors without a product or of
    another dimension than the most frequent one, queries without text, of another dimension, or of an unknown product.
    """
    size = vectors.where("vector is not null").groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    ids = catalog.select(F.col("id").alias("__id")).where("__id is not null").distinct()
    apart = lambda rows: rows.crossJoin(F.broadcast(size)).where("vector is null or size(vector) <> d")
    count = lambda rows, problem: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(problem).alias("problem"), "n")
    found = [
        count(ids.join(vectors.select(F.col("id").alias("__id")), "__id", "left_anti"), "product without a vector"),
        count(vectors.join(ids, F.col("id") == F.col("__id"), "left_anti"), "vector without a product"),
        count(apart(vectors), "vector of another dimension"),
        count(queries.where("coalesce(query, '') = ''"), "query without a text"),
        count(apart(queries), "query of another dimension"),
        count(queries.join(ids, F.col("product_id") == F.col("__id"), "left_anti"), "query of an unknown product"),
    ]
    return combine(found).where("n > 0")


def disjoint(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The values that both tables have; empty if they are disjoint."""
    return a.select(column).intersect(b.select(column))


def convert_listings(listings: DataFrame, images: DataFrame, source: str, license: str, languages: list[str] = ("zh_CN", "en_US")) -> DataFrame:
    """Catalog rows of public listings that have a known main image and a title.

    listings: item_id, domain_name, main_image_id, product_type, and arrays of (language_tag, value); images: image_id, path.
    """
    paths = images.select(F.col("image_id").alias("main_image_id"), F.col("path").alias("image_path")).dropDuplicates(["main_image_id"])
    pick = lambda c: X.localized_pick(F.col(c), list(languages))
    pairs = {"品牌": "brand", "颜色": "color", "材质": "material", "风格": "style"}
    attributes = F.map_filter(F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), pick(c)))), lambda k, v: v != "")
    body = F.concat_ws(" ", *(F.nullif(X.localized_join(F.col(c), list(languages)), F.lit("")) for c in ("bullet_point", "product_description")))
    named = listings.join(paths, "main_image_id").withColumn("title", pick("item_name")).where("title <> ''")
    return named.select(
        F.concat_ws(":", F.coalesce("domain_name", F.lit("amazon")), "item_id").alias("id"),
        "title",
        F.coalesce(F.nullif("product_type", F.lit("")), F.lit("unknown")).alias("category"),
        F.coalesce(F.nullif(X.strip_html(body), F.lit("")), "title").alias("description"),
        F.lit(0.0).alias("price"),
        attributes.alias("attributes"),
        "image_path",
        F.lit(0.0).alias("rating"),
        F.lit(1).alias("stock"),
        F.lit(source).alias("source"),
        F.lit(license).alias("license"),
    )


def listing_counts(listings: DataFrame, images: DataFrame, languages: list[str] = ("zh_CN", "en_US")) -> DataFrame:
    """One row: converted, skipped_missing_image, skipped_missing_title."""
    known = images.select(F.col("image_id").alias("__i")).distinct()
    joined = listings.join(known, F.col("main_image_id") == F.col("__i"), "left")
    titled = X.localized_pick(F.col("item_name"), list(languages)) != ""
    has = F.col("__i").isNotNull()
    return joined.agg(F.count_if(has & titled).alias("converted"), F.count_if(~has).alias("skipped_missing_image"), F.count_if(has & ~titled).alias("skipped_missing_title"))


def cross_view_cases(listings: DataFrame, images: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, image_path, relevant_id): for catalog products of no split or test, the first other image of their listing that is known."""
    wanted = catalog.where(F.coalesce(X.plain_split(F.col("split")), F.lit("test")) == "test").select(F.col("id").alias("relevant_id"), F.element_at(F.split("id", ":", 2), -1).alias("item_id"))
    others = listings.select("item_id", F.posexplode("other_image_id").alias("pos", "image_id")).join(images.select("image_id", "path"), "image_id")
    first = others.groupBy("item_id").agg(F.min(F.struct("pos", "path")).alias("m"))
    return first.join(wanted, "item_id").select(F.concat(F.lit("cross-view-"), "relevant_id").alias("id"), F.col("m.path").alias("image_path"), "relevant_id")


def pending_images(listings: DataFrame, existing: DataFrame, first: int | None = None) -> DataFrame:
    """Image ids of listings (of the first ones by id, if a number is given) that aren't there yet."""
    rows = listings if first is None else listings.orderBy("item_id").limit(first)
    return rows.select(F.col("main_image_id").alias("image_id")).where("image_id is not null").distinct().join(existing.select("image_id"), "image_id", "left_anti")


def anchor_mismatch(pairs: DataFrame, key: str, query: str, document: str) -> DataFrame:
    """(key, missing, foreign): words of three letters or more and numbers of the query that its document lacks, and
    whether another document of the table has one of them."""
    words = lambda c: F.array_distinct(X.found(F.lower(c), r"[a-z]{3,}|\d+"))
    own = pairs.select(F.col(key).alias("k"), words(F.col(query)).alias("q"), words(F.col(document)).alias("d"))
    lacking = own.select("k", F.array_except("q", "d").alias("missing"))
    held = own.select(F.explode("d").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w")
    hit = lacking.select("k", F.explode("missing").alias("w")).join(held, "w", "left_semi").select("k").distinct().withColumn("foreign", F.lit(True))
    return lacking.join(hit, "k", "left").select(F.col("k").alias(key), "missing", F.coalesce("foreign", F.lit(False)).alias("foreign"))


def attribute_rows(rows: DataFrame, key: str = "id", attributes: str = "attributes") -> DataFrame:
    """(key, attribute, value) of each attribute that isn't null or empty."""
    return rows.select(F.col(key), F.explode(F.map_filter(attributes, lambda k, v: F.coalesce(v, F.lit("")) != "")).alias("key", "value"))


def combine(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    return reduce(DataFrame.unionByName, tables)


def latest_readings(readings: DataFrame, key: str, observed: str, recorded: str) -> DataFrame:
    """The last reading of each key by the time it was observed, then by when it was recorded, then by its columns; rows
    without key or time don't count. Readings are reduced before the shuffle, so a hot key is no hot task."""
    rest = [c for c in readings.columns if c not in (key, observed, recorded)]
    best = readings.where(F.col(key).isNotNull() & F.col(observed).isNotNull()).groupBy(key).agg(F.max(F.struct(observed, recorded, *rest)).alias("m"))
    return best.select(key, *(F.col("m")[c].alias(c) for c in readings.columns if c != key))
