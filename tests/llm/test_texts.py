import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import languages, lookalike, overlap

SAME = [
    ("ＡＢＣ１２", "ABC12"),
    ("a​b﻿", "ab"),
    ("a  　b ", "a b"),
    ("café", "café"),
    ("cafe͏́", "café"),
    ("VЈККТD", "VJKKTD"),
    ("ЅСР", "SCP"),
    ("ﬁn", "fin"),
    ("ﾊﾞｯｸﾞ", "バッグ"),
    ("⽔", "水"),
    ("a‐b−c", "a-b-c"),
    ("，（x）", ",(x)"),
    ("ë ", "ë"),
    ("ё", "ë"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looks_have_one_form(a, b):
    assert lookalike.canonical(a) == lookalike.canonical(b) == b


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a b", "ab"), ("a.", "a"), ("x²", "x2"), ("0", "O"), ("力", "刀")])
def test_visible_differences_stay(a, b):
    assert lookalike.canonical(a) != lookalike.canonical(b)


def test_tokens_are_spelled_in_one_script():
    assert lookalike.canonical("Пpивeт") == "Привет"
    assert lookalike.resolve("Привет") == ("Привет", "single")
    assert lookalike.resolve("сор") == ("cop", "whole")
    assert lookalike.resolve("pаy")[1] == "mixed"
    assert lookalike.canonical("カタ力ナ") == lookalike.canonical("カタカナ") == "カタカナ"
    assert lookalike.findings("ＡＢ plain") is None and lookalike.findings("VЈК") == "mixed"


def test_shapes_of_other_scripts(spark):
    all_scripts = lookalike.shapes(spark)
    letters = dict(all_scripts.others)
    assert len({lookalike._script(x) for x in letters}) > 20 and letters["Ꭺ"] == "A" and letters["օ"] == "o" and letters["ꓲ"] == "l"
    for letter, latin in letters.items():
        # Alone, a letter is a whole-script confusable; beside one that only Latin has, it makes a mixed token.
        assert all_scripts.resolve(letter) == (latin, "whole")
        assert all_scripts.canonical(f"{letter}éñ") == f"{latin}éñ" == all_scripts.canonical(f"{latin}éñ")
        assert all_scripts.findings(f"{letter}kñ") == "mixed"
    scripts = {}
    for letter, latin in letters.items():
        scripts.setdefault(lookalike._script(letter), {}).setdefault(latin, letter)
    for a in scripts.values():  # every pair of scripts that share a shape
        for b in scripts.values():
            for latin in a.keys() & b.keys():
                assert all_scripts.canonical(a[latin] + "x") == all_scripts.canonical(b[latin] + "x")
    assert all_scripts.canonical("ᏣᎳᎩ") == "ᏣᎳᎩ" and all_scripts.resolve("ᏣᎳᎩ")[1] == "single"  # a word of its own script
    assert all_scripts.canonical("Привет") == "Привет"
    import pickle

    assert pickle.loads(pickle.dumps(all_scripts)) is all_scripts


def test_shapes_without_the_library_are_an_error(spark):
    class Without:  # a package that isn't on the class path can't be called
        _jvm = type("Jvm", (), {"com": spark._jvm.none})()

    class NoGateway:
        pass

    for session in (Without(), NoGateway()):
        with pytest.raises(RuntimeError, match="ICU"):
            lookalike.shapes(session)


def test_large_classes_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PAIRED", 7)
    data = [(f"{i:03}", "ab" if i % 3 else "a\u200bb") for i in range(60)] + [("900", "other")]
    table = spark.createDataFrame(data, "id string, t string")
    got = {(r[1], r[2]) for r in lookalike.lookalike_pairs(table, F.col("id"), F.col("t"), F.lit("q")).collect()}
    assert got == {(a, b) for a, x in data for b, y in data if a < b and x != y and "other" not in (x, y)}
    classes = lookalike.lookalike_classes(table, F.col("id"), F.col("t"), F.lit("q")).collect()
    assert [(r["form"], r["spellings"], r["rows"]) for r in classes] == [("ab", 2, 60)]


@settings(deadline=None, max_examples=200)
@given(st.text())
def test_forms_are_stable(text):
    form = lookalike.canonical(text)
    assert lookalike.canonical(form) == form


def test_empty_and_long():
    assert lookalike.canonical(None) is None and lookalike.canonical("​ \n") == ""
    assert len(lookalike.canonical("Ａ" * 1_000_000)) == 1_000_000


def test_pairs_of_spellings(spark, rows):
    data = [("1", "ab"), ("2", "a​b"), ("3", "ab"), ("4", None), (None, "ａb"), ("5", "AB"), ("2", "a​b"), ("6", "")]
    table = spark.createDataFrame(data, "id string, t string").withColumns({"g": F.lit("x"), "form": F.lit(1), "h": F.lit(2)})
    got = lookalike.lookalike_pairs(table, F.col("id"), F.col("t"), F.lit("title"))
    assert rows(got) == [("title", "1", "2"), ("title", "2", "3")]
    assert rows(lookalike.lookalike_pairs(table.limit(0), F.col("id"), F.col("t"), F.lit("q"))) == []
    assert rows(lookalike.lookalike_forms(table.where("id in ('4', '5', '6')"), "id", "t")) == [("4", None, None), ("5", "AB", None), ("6", "", None)]


WORDS = {
    "en": "the parcel left the warehouse with one dented box and returns must be asked for within three days".split(),
    "de": "das paket wurde nach stunden verschickt und der karton war leicht beschädigt man sollte die teile reinigen".split(),
    "fr": "le colis est parti de l'entrepôt avec une boîte abîmée et les retours sont acceptés dans les heures".split(),
    "es": "el paquete salió del almacén con una caja dañada y las devoluciones se piden dentro de los días".split(),
    "pt": "a encomenda saiu do armazém com uma caixa amassada e as devoluções devem ser pedidas em até horas".split(),
    "zh": "仓库在小时内 发出包裹了 外箱有一点压痕 退货要在签收后 提出并保留标签 和全部配件".split(),
    "ja": "荷物は時間で 発送されましたが 箱が少し へこんでいました 返品はタグと 部品をそろえて ください".split(),
}


def sentence(rng, lang):
    picked = rng.choices(WORDS[lang], k=12)
    return "".join(picked) + "。" if lang in ("zh", "ja") else " ".join(picked).capitalize() + "."


def corpus(spark):
    rng = random.Random(5)
    products, labels = [], []
    for i in range(420):
        lang = languages.LANGUAGES[i % 7]
        products.append((f"p{i}", " ".join(sentence(rng, lang) for _ in range(3))))
        wrong = rng.random() < 0.08
        labels.append((f"p{i}", rng.choice(languages.LANGUAGES) if wrong else lang.upper() + "-XX" if i % 5 == 0 else lang))
    mixed = sentence(rng, "en") + " " + sentence(rng, "zh") + sentence(rng, "zh") + "\n" + sentence(rng, "de")
    products += [("mixed", mixed), ("figures", "J4763V 988g 58.2-27"), ("empty", ""), ("null", None), (None, sentence(rng, "en")), ("unlabelled", sentence(rng, "fr")), ("long", sentence(rng, "es") * 3000)]
    labels += [("mixed", "en"), ("figures", "en"), ("long", "es"), (None, "en"), ("und", None), ("p0", "??")]
    return spark.createDataFrame(products, "id string, text string").withColumn("__id", F.lit(1)), spark.createDataFrame(labels[:-1], "product_id string, lang_label string")


def test_language_of_each_document(spark):
    products, labels = corpus(spark)
    found = {r["product_id"]: r for r in languages.document_languages(products, labels, ["text"]).collect()}
    assert len(found) == products.select("id").distinct().count()
    assert sum(found[f"p{i}"]["lang"] == languages.LANGUAGES[i % 7] for i in range(420)) >= 415
    for name in ("figures", "empty", "null"):
        assert found[name]["lang"] == languages.UNKNOWN and found[name]["confidence"] == 0 == found[name]["share"]
    assert found["mixed"]["n_langs"] == 3 and 0 < found["mixed"]["share"] < 1 and found["p0"]["share"] == 1.0
    assert languages.document_languages(products.limit(0), labels, ["text"]).count() == 0


def test_confidence_is_calibrated():
    rng = random.Random(3)
    made = [(lang, sentence(rng, lang)) for lang in languages.LANGUAGES for _ in range(300)]
    models = languages.train([x for i, x in enumerate(made) if i % 3])
    held = [(languages.LANGUAGES.index(lang), part) for lang, text in made[::3] for s in languages.sentences(text) for part in (s[1:4], s[5:10], s[2:14])]
    _, confidence = models.choose([t for _, t in held])
    right = models.score([t for _, t in held]).argmin(axis=1) == [i for i, _ in held]
    assert right.mean() < 1 and languages.reliability(confidence, right) < 0.06


def test_language_segments(spark, rows):
    products, labels = corpus(spark)
    found = languages.segments(products, labels, ["text"]).cache()
    segs = {}
    for r in found.orderBy("segment_no").collect():
        segs.setdefault(r["product_id"], []).append(r["lang"])
        assert 0 < r["confidence"] <= 1
    right = sum(segs[f"p{i}"] == [languages.LANGUAGES[i % 7]] for i in range(420))
    assert right >= 415
    assert segs["mixed"] == ["en", "zh", "de"] and segs["long"] == ["es"]
    assert not {"figures", "empty", "null", None} & set(segs)
    listed = {r["product_id"] for r in languages.mislabelled(found, labels).collect()}
    assert {"mixed", "unlabelled"} <= listed and "long" not in listed
    empty = languages.segments(products.limit(0), labels.limit(0), ["text"])
    assert rows(empty) == []


def test_labels(spark):
    data = spark.createDataFrame([("ZH-cn",), ("zh_Hans",), (" de ",), ("und",), ("",), (None,), ("english",), ("pt-BR",)], "l string")
    assert [r[0] for r in data.select(languages.plain_label(F.col("l"))).collect()] == ["zh", "zh", "de", None, None, None, None, "pt"]


def test_kneser_ney_is_a_distribution():
    import numpy as np

    orders = languages._kneser_ney(["abab", "abba", "aab"])
    gram, log, *_ = orders[1]
    context, weight = orders[1][2:]
    rest = np.exp(weight[0]) * (languages.ALPHABET - len(gram)) / languages.ALPHABET
    assert np.exp(log).sum() + rest == pytest.approx(1)


def brute_overlap(rows, placeholders):
    plain = [(i, {"val": "validation", "valid": "validation", "dev": "validation"}.get((s or "").strip().lower(), (s or "").strip().lower()), overlap.plain_title(t), h) for i, s, t, h in rows]
    out = set()
    for a, sa, ta, ha in plain:
        for b, sb, tb, hb in plain:
            if sa == "train" and sb in ("validation", "test"):
                x, y = (overlap.pieces(t) if t else set() for t in (ta, tb))
                near = bool(x and y) and len(x & y) / len(x | y) >= 0.78
                if near or (ha and ha == hb and ha not in placeholders):
                    out.add((min(a, b), max(a, b)))
    return sorted(out)


def test_overlap_against_brute_force(spark, rows):
    rng = random.Random(11)
    words = ["steel", "lamp", "kettle", "blue", "desk", "quiet", "hinge", "camping", "travel", "bag", "徒步鞋", "适合雨天", "保温水壶"]
    data = []
    for i in range(260):
        base = " ".join(rng.choices(words, k=rng.randrange(1, 9))) + f" {rng.randrange(10**6):x}" * rng.randrange(2)
        for _ in range(rng.randrange(1, 4)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice("xyz9")
            data.append((f"p{len(data):04d}", rng.choice(["train", " Train", "val", "TEST", "dev", None, "other"]), "".join(t), rng.choice(["aa", "bb", "ee", None]) if i % 40 == 0 else None))
    data += [("n1", "train", None, "cc"), ("n2", "test", "", "cc"), ("s1", "train", "ab", None), ("s2", "test", "a b", None), ("r1", "train", "a" * 400, None), ("r2", "test", "a" * 500, None)]
    data += [("l1", "train", "lorem ipsum dolor " * 4000, None), ("l2", "test", "lorem ipsum dolor " * 4000 + "x", None), data[0]]
    table = spark.createDataFrame(data, "id string, split string, title string, image_sha256 string").withColumns({"source": F.lit("s"), "t": F.lit(1), "c": F.lit(2), "image": F.lit(3)})
    none = spark.createDataFrame([("bb", "x")], "image_sha256 string, note string")
    got = overlap.cross_split_pairs(table, none)
    assert rows(got.select(F.least("train_id", "other_id"), F.greatest("train_id", "other_id"))) == brute_overlap(data, {"bb"})
    assert got.where("similarity is not null and (similarity < 0.78 or coverage <= 0 or coverage > 1)").count() == 0
    assert rows(overlap.cross_split_pairs(table.limit(0), none.limit(0))) == []
    report = {(r["split"], r["source"]): r["records"] for r in overlap.overlap_report(table.limit(50), none).collect()}
    assert sum(report.values()) == sum(1 for _, s, *_ in data[:50] if s and s.strip().lower() in ("train", "val", "test", "dev"))


def test_chains():
    assert overlap.chain([(0, 0), (5, 5), (3, 9), (8, 7)]) == [(0, 0), (5, 5), (8, 7)]
    assert overlap.aligned("abcdefgh", "abcXefgh", [(0, 0), (4, 4)]) == 7
    assert overlap.chain([]) == []


def test_plain_hashes(spark):
    data = spark.createDataFrame([(" SHA256:AbC ",), ("abc",), ("",), (None,)], "h string")
    assert [r[0] for r in data.select(overlap.plain_hash(F.col("h"))).collect()] == ["abc", "abc", None, None]
