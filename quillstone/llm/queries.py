"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.llm import languages, lookalike, mixture, nearest, overlap, packing, spans
from quillstone.session import table

QUERIES, ORACLE = {}, {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _with_sql(sql):
    def add(f):
        ORACLE[f.__name__] = sql
        return _query(f)

    return add


def _looked_at(spark, d):
    queries = table(spark, d, "planner_test").select(F.lit("query").alias("field_name"), "id", F.col("query").alias("text"))
    return queries.unionAll(table(spark, d, "products").select(F.lit("title"), "id", "title"))


def _form_sql(text: str) -> str:
    """The look-alike form in SQL, as far as these tables need it: one class of Kana and Han of a shape, no tokens of other scripts."""
    fold = {chr(c): x for c, x in lookalike.FOLD.items() if len(x) == 1}
    fold |= {x: row[0] for row in lookalike.SHAPES if row[0] != "." for x in row[1:] if x != "."}
    fold = {x: fold.get(y, y) for x, y in fold.items() if x != "'"}
    quote = lambda x: x.replace("'", "''")
    plain = rf"""regexp_replace({text}, '[\x{{AD}}\x{{34F}}\x{{61C}}\x{{180B}}-\x{{180E}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g')"""
    longer = {chr(c): x for c, x in lookalike.FOLD.items() if chr(c) in "ﬀﬁﬂﬃﬄ"}
    for x, y in longer.items():
        plain = f"replace({plain}, '{x}', '{y}')"
    plain = f"translate({plain}, '{quote(''.join(fold))}', '{quote(''.join(fold.values()))}')"
    kana = lookalike.KANA_HAN.split() + lookalike.KANA_KANA.split()  # after marks are composed with them
    return rf"trim(regexp_replace(translate(nfc_normalize({plain}), '{''.join(x[0] for x in kana)}', '{''.join(x[1] for x in kana)}'), '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


@_with_sql(
    f"""with t as (select 'query' as field_name, id, query as t from planner_test union all select 'title', id, title from products),
f as (select field_name, id, t, {_form_sql('t')} as form from t where id is not null and t is not null)
select distinct a.field_name, a.id as id_a, b.id as id_b from f a join f b on a.field_name = b.field_name and a.form = b.form and a.id < b.id and a.t <> b.t"""
)
def p5_found(spark, d):
    pairs = lookalike.lookalike_pairs(_looked_at(spark, d), F.col("id"), F.col("text"), F.col("field_name"))
    return pairs.withColumnRenamed("group", "field_name")


@_query
def p5_forms(spark, d):
    forms = lookalike.lookalike_forms(_looked_at(spark, d).withColumn("key", F.struct("field_name", "id")), "key", "text")
    return forms.select("key.field_name", "key.id", "form", "script_finding")


@_query
def p5_classes(spark, d):
    found = lookalike.lookalike_classes(_looked_at(spark, d), F.col("id"), F.col("text"), F.col("field_name"))
    return found.withColumnRenamed("group", "field_name")


@_with_sql(
    """with v as (select vec_id, dimension, vectors::double[] as v from vectors where vec_id is not null and len(vectors) = dimension and dimension > 0
  and len([x for x in vectors if x is null or not isfinite(x)]) = 0 and len([x for x in vectors if x <> 0]) > 0),
near as (select a.vec_id, b.vec_id as other from v a join v b on a.dimension = b.dimension and a.vec_id <> b.vec_id
  qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.v, b.v) desc, b.vec_id) <= 5)
select distinct least(vec_id, other) as vec_id_a, greatest(vec_id, other) as vec_id_b from near"""
)
def p4_found(spark, d):
    return nearest.neighbour_pairs(nearest.nearest(table(spark, d, "vectors")))


_P8 = """text as (select doc_id, text from documents where doc_id is not null and length(text) >= 200),
pieces as (select doc_id, i - 1 as s, substr(text, i, 200) as x from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from text)),
twice as (select x from pieces group by x having min(doc_id) <> max(doc_id)),
hits as (select distinct doc_id, s from pieces join twice using (x)),
marked as (select doc_id, s, coalesce(s - lag(s) over (partition by doc_id order by s) > 200, true)::int as new from hits),
islands as (select doc_id, s, sum(new) over (partition by doc_id order by s) as island from marked),
spans as (select doc_id, min(s)::int as start_char, max(s)::int + 200 as end_char from islands group by doc_id, island)"""


@_with_sql(f"with {_P8} select * from spans")
def p8_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


@_with_sql(
    f"with {_P8}, one as (select doc_id, sum(end_char - start_char) as shared_chars, count(*) as n_spans from spans group by doc_id) select d.doc_id, length(d.text) as n_chars, coalesce(shared_chars, 0)::bigint as shared_chars, coalesce(n_spans, 0) as n_spans, case when length(d.text) > 0 then coalesce(shared_chars, 0) / length(d.text) end as share from documents d left join one using (doc_id)"
)
def p8_shares(spark, d):
    return spans.shared_shares(table(spark, d, "documents"))


@_query
def p8_removed(spark, d):
    return spans.without_repetitions(table(spark, d, "documents"))


def _segments(spark, d):
    return languages.segments(table(spark, d, "products"), table(spark, d, "product_langs"), ["title", "description"])


@_query
def p3_found(spark, d):
    return languages.mislabelled(_segments(spark, d), table(spark, d, "product_langs")).select("product_id", "field_name", "segment_no", "lang")


@_query
def p3_languages(spark, d):
    return languages.document_languages(table(spark, d, "products"), table(spark, d, "product_langs"), ["title", "description"])


@_query
def p3_segments(spark, d):
    return _segments(spark, d)


_P2 = rf"""form as (select id, case when lower(trim(split)) in ('val', 'valid', 'dev', 'validation') then 'validation' else lower(trim(split)) end as split,
  regexp_replace(lower(trim(image_sha256)), '^sha256:\s*', '') as image, regexp_replace(lower({_form_sql('title')}), '[^\p{{L}}\p{{N}}]', '', 'g') as t from products where id is not null),
rows as (select id, split = 'train' as train, case when image <> '' and image not in (select regexp_replace(lower(trim(image_sha256)), '^sha256:\s*', '') from placeholder_images where image_sha256 is not null) then image end as image,
  list_distinct(case when length(t) >= 3 then [t[i:i + 2] for i in range(1, length(t) - 1)] when t <> '' then [t] end) as pieces from form where split in ('train', 'validation', 'test'))"""


@_with_sql(
    f"""with {_P2}, common as (select a.id as a, b.id as b, count(*) as n from (select id, unnest(pieces) as p from rows where train) a join (select id, unnest(pieces) as p from rows where not train) b using (p) group by all),
pairs as (select a.id as a, b.id as b from rows a join rows b on a.train and not b.train and a.image = b.image
  union select a, b from common join rows x on x.id = a join rows y on y.id = b where n >= 0.78 * (len(x.pieces) + len(y.pieces) - n) - 1e-12)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from pairs where a <> b"""
)
def p2_found(spark, d):
    pairs = overlap.cross_split_pairs(table(spark, d, "products"), table(spark, d, "placeholder_images"))
    return pairs.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


@_query
def p2_report(spark, d):
    return overlap.overlap_report(table(spark, d, "products"), table(spark, d, "placeholder_images"))


@_query
def p6_packed(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


# Token counts aren't expressible in SQL; what must hold for them is.
@_with_sql("select count(*) as documents, true as whole, true as fits, true as cut_only_if_longer, true as little_room from documents where doc_id is not null and text <> ''")
def p6_report(spark, d):
    rows = table(spark, d, "documents")
    packed = packing.pack_documents(rows)
    return packing.packing_check(rows, packed)


def _mix(spark, d):
    targets = table(spark, d, "mix_targets")
    corpus = mixture.lay_out(mixture.sized_documents(table(spark, d, "documents")), targets)
    return corpus, mixture.plan(corpus, targets)


@_query
def p7_mix(spark, d):
    return mixture.mixed_documents(*_mix(spark, d))


PLAIN = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g')"


@_with_sql(
    f"""with t as (select mix_id, {PLAIN.format("source")} as source, sum(target_share) as target, max(max_repeats) as cap from mix_targets group by all),
held as (select distinct {PLAIN.format("source")} as source from documents where text <> ''),
live as (select mix_id, sum(target) as total from t join held using (source) group by mix_id)
select t.mix_id, t.source, t.target as target_share, h.source is not null as available, round(case when h.source is null then 0 else t.target / l.total end, 9) as reachable_share,
  true as share_met, true as cap_kept, true as none_lost from t left join held h using (source) left join live l using (mix_id)"""
)
def p7_shares(spark, d):
    return mixture.share_check(*_mix(spark, d)).withColumn("reachable_share", F.round("reachable_share", 9))


@_query
def p7_report(spark, d):
    return mixture.share_report(*_mix(spark, d))


@_query
def p7_blocks(spark, d):
    return mixture.mixed_blocks(*_mix(spark, d))


@_query
def p7_filled(spark, d):
    return mixture.filled_blocks(*_mix(spark, d))
