"""One form for texts that look the same.

Invisible characters go, compatibility forms of the same shape (full and half width, ligatures, radicals, spaces) become
their plain letters, and look-alike letters are respelled in one script. For that, each letter stands for its *shape*:
the set of scripts that have a letter of this shape. The resolved scripts of a token are the intersection over its
shapes. If several are left (a whole-script confusable), the first of SCRIPTS is chosen; if one is left, the token is
spelled in it, so a mixed spelling becomes consistent; if none is left, each letter gets its shape's first script. The
result depends on the shapes alone and is therefore the same for all texts that look alike.

Latin, Greek and Cyrillic shapes are listed below, case by case. Those of all other scripts (Cherokee, Armenian, Coptic, Lisu,
Hebrew, Arabic and more) come from the confusables of the Unicode data, which the ICU library on Spark's class path
carries: shapes() asks it on the driver, and the tasks get the answer. Kana and Han of one shape are written together in Japanese, so
their script sets don't decide; the characters beside them do.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCRIPTS = ("Latin", "Greek", "Cyrillic")
# Letters of the same shape in Latin, Greek and Cyrillic ("." where the script has none).
SHAPES = (
    "AΑА BΒВ CϹС EΕЕ FϜ. HΗН IΙІ JͿЈ KΚК MΜМ NΝ. OΟО PΡР Q.Ԛ S.Ѕ TΤТ V.Ѵ W.Ԝ XΧХ YΥҮ ZΖ. G.Ԍ .ΓГ .ΠП .ΦФ "
    "aαа cϲс d.ԁ e.е h.һ iιі jϳј l.ӏ oοо pρр q.ԛ s.ѕ uυ. vνѵ w.ԝ x.х yγу ßβ."
).split()
# A sign and those that look like it.
SIGNS = {"-": "‐‑‒–−⁃˗﹣", "'": "’ʼ＇′", "/": "∕⁄", "*": "∗", "~": "〜∼", ":": "∶꞉", "·": "‧∙⋅", "a": "ɑ", "g": "ɡ", "I": "Ӏ", "y": "ү"}
# Katakana and Han of the same shape, and Hiragana and Katakana of the same shape.
KANA_HAN = "カ力 ニ二 ロ口 エ工 タ夕 ト卜 ハ八 ー一"
KANA_KANA = "ヘへ ベべ ペぺ"
FOLDED = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>"}

INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--\p{White_Space}]+", regex.V1)
ALPHABETIC = regex.compile(r"[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\p{Lm}]]++", regex.V1)
FOREIGN = r"\p{Greek}\p{Cyrillic}"
KATAKANA = regex.compile(r"\p{Katakana}")


def _fold_table() -> dict[int, str]:
    """Compatibility characters that keep their shape when decomposed; built from the Unicode data, not listed."""
    table = {}
    for span in (range(0xA0, 0x3400), range(0xF900, 0x10000), range(0x1D400, 0x1D800)):
        for code in span:
            kind, *rest = unicodedata.decomposition(chr(code)).split() or [""]
            if kind in FOLDED and not (rest[0] == "0020" and len(rest) > 1):
                table[code] = unicodedata.normalize("NFKC", chr(code))
    return table | {ord(x): sign for sign, others in SIGNS.items() for x in others}


FOLD = _fold_table()
AMBIGUOUS_CJK = {x: (pair[0], pair[1]) for pair in (KANA_HAN + " " + KANA_KANA).split() for x in pair}
CJK_RUN = regex.compile("[" + "".join(AMBIGUOUS_CJK) + "]+")
SPECIAL_CHARACTER = regex.compile(r"[\p{M}\p{Greek}\p{Cyrillic}\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}\u2E80-\u2FDF\uF900-\uFAFF]")
#: Characters that canonical() may change; the look-up is much faster than a pattern.
SPECIAL = frozenset(x for x in map(chr, [*range(0x20), *range(0x7F, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE1000)]) if ord(x) in FOLD or SPECIAL_CHARACTER.match(x))
CJK_SPECIAL = frozenset(AMBIGUOUS_CJK)


def _script(letter: str) -> str:
    """The script by the first word of the letter's name; empty for marks, which go with any."""
    return "" if unicodedata.category(letter)[0] == "M" else unicodedata.name(letter, "").split(" ")[0].title()


class Shapes:
    """Letter shapes, and the forms of texts by them. others: (letter, Latin letter) of the same shape, of scripts beyond SCRIPTS."""

    def __init__(self, others: tuple[tuple[str, str], ...] = ()) -> None:
        self.others = others
        self.rows = {letter: dict(zip(SCRIPTS, row)) for row in SHAPES for letter in row if letter != "."}
        for row in self.rows.values():
            for script in [x for x, letter in row.items() if letter == "."]:
                del row[script]
        for letter, latin in others:
            row = self.rows.setdefault(latin, {"Latin": latin})
            row.setdefault(_script(letter), letter)  # a script's first letter of a shape stands for its others
            self.rows[letter] = row
        self.scripts = (*SCRIPTS, *sorted({_script(x) for x, _ in others} - set(SCRIPTS)))
        self.foreign = regex.compile(f"[{FOREIGN}{''.join(x for x, _ in others)}]")
        self.special = SPECIAL | {x for x, _ in others}
        self.found: dict[str, frozenset[str]] = {}

    def __reduce__(self):
        return _shapes, (self.others,)

    def scripts_of(self, letter: str) -> frozenset[str]:
        """The scripts that have a letter of this shape; empty for marks."""
        if letter not in self.found:
            row = self.rows.get(letter)
            self.found[letter] = frozenset(row) if row else frozenset(filter(None, [_script(letter)]))
        return self.found[letter]

    def resolve(self, token: str) -> tuple[str, str]:
        """A token's consistent spelling, and what it was: 'single' script, 'mixed' or 'whole' (another script could spell it)."""
        sets = [x for x in map(self.scripts_of, token) if x]
        left = frozenset.intersection(*sets) if sets else frozenset()
        used = {y for y in map(_script, token) if y}
        kind = "mixed" if len(used) > 1 else "whole" if len(left) > 1 else "single"
        target = next((x for x in self.scripts if x in left), None)

        def spell(letter: str) -> str:
            row = self.rows.get(letter)
            return letter if row is None else row.get(target, letter) if target else row[next(x for x in self.scripts if x in row)]

        return "".join(map(spell, token)), kind

    def _token(self, match: regex.Match) -> str:
        return self.resolve(match.group())[0] if self.foreign.search(match.group()) else match.group()

    def canonical(self, text: str | None) -> str | None:
        """The form; null stays null, a text without visible characters becomes ''."""
        if text is None:
            return None
        if not text.isascii():
            if not self.special.isdisjoint(text):
                text = unicodedata.normalize("NFD", INVISIBLE.sub("", text).translate(FOLD)).translate(FOLD)
                if self.foreign.search(text):
                    text = ALPHABETIC.sub(self._token, text)
                text = unicodedata.normalize("NFC", text)
            if not CJK_SPECIAL.isdisjoint(text):
                text = CJK_RUN.sub(_resolve_cjk, text)
        elif not text.isprintable():
            text = INVISIBLE.sub("", text)
        return " ".join(text.split())

    def findings(self, text: str | None) -> str | None:
        """'mixed' if a token mixes scripts, 'whole' if it is a whole-script confusable, else null."""
        if text is None or text.isascii():
            return None
        plain = unicodedata.normalize("NFD", INVISIBLE.sub("", text).translate(FOLD))
        kinds = {self.resolve(m.group())[1] for m in ALPHABETIC.finditer(plain) if self.foreign.search(m.group())}
        return "mixed" if "mixed" in kinds else "whole" if "whole" in kinds else None


@lru_cache(maxsize=4)
def _shapes(others: tuple[tuple[str, str], ...]) -> Shapes:
    return Shapes(others)


@lru_cache(maxsize=1)
def _confusable_letters(icu) -> tuple[tuple[str, str], ...]:
    letters = [chr(i) for i in [*range(0x250, 0x2E80), *range(0xA000, 0xD7A4), *range(0x10000, 0x17000), *range(0x1E000, 0x1F000)] if unicodedata.category(chr(i))[0] == "L" and i not in FOLD]
    letters = [x for x in letters if not unicodedata.decomposition(x) and _script(x) not in SCRIPTS]
    like = icu.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    # The data has one skeleton for I, l, 1 and |: upper-case letters go with I, others with l.
    return tuple((x, "I" if y == "l" and unicodedata.category(x) == "Lu" else y) for x, y in zip(letters, like, strict=True) if len(y) == 1 and y.isascii() and y.isalpha())


def shapes(spark: SparkSession) -> Shapes:
    """The shapes of all scripts. Without the ICU library there are none, and forms by SCRIPTS alone would look like whole ones, so that is an error."""
    try:
        return _shapes(_confusable_letters(spark._jvm.com.ibm.icu.text))
    except (TypeError, AttributeError) as missing:  # not on the class path, or no gateway to it
        raise RuntimeError("look-alike forms need the ICU library (icu4j) on the driver's class path and a session with a gateway to it") from missing


def _resolve_cjk(match: regex.Match) -> str:
    text, (start, end) = match.string, match.span()
    kana = any(KATAKANA.match(x) for x in (text[start - 1 : start] or " ", text[end : end + 1] or " "))
    return "".join(AMBIGUOUS_CJK[x][0 if kana else 1] for x in match.group())


DEFAULT = _shapes(())
canonical, findings, resolve = DEFAULT.canonical, DEFAULT.findings, DEFAULT.resolve


def per_text(f, text: Column) -> Column:
    """f of each text. Not deterministic, to the optimizer: else a join or filter on the result makes it once more."""
    return F.arrow_udf(lambda texts: pa.array(map(f, texts.to_pylist()), pa.string()), T.StringType()).asNondeterministic()(text)


def lookalike_forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, script_finding) for each row, repeated rows too; a null text has a null form."""
    by = shapes(rows.sparkSession)
    return rows.select(F.col(key), per_text(by.canonical, F.col(text)).alias("form"), per_text(by.findings, F.col(text)).alias("script_finding"))


def _spellings(rows: DataFrame, key: Column, text: Column, group: Column) -> tuple[DataFrame, DataFrame]:
    """Named rows (g, id, t), and distinct spellings (g, t, form, n) of n rows each."""
    named = rows.select(group.alias("g"), key.alias("id"), text.alias("t")).where("id is not null and t is not null")
    by = shapes(rows.sparkSession)
    return named, named.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n")).select("g", "t", per_text(by.canonical, F.col("t")).alias("form"), "n")


def lookalike_classes(rows: DataFrame, key: Column, text: Column, group: Column) -> DataFrame:
    """(group, class_id, form, spellings, rows): the forms that texts of a group are stored in several spellings of; the class id
    is a hash of group and form. Rows with a null id or text count nowhere."""
    _, spelled = _spellings(rows, key, text, group)
    return spelled.groupBy("g", "form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1").select(F.col("g").alias("group"), F.xxhash64("g", "form").alias("class_id"), "form", "spellings", "rows")


#: Rows of a class that are paired in one task, about.
PAIRED = 4096


def lookalike_pairs(rows: DataFrame, key: Column, text: Column, group: Column) -> DataFrame:
    """(group, id_a, id_b): pairs of rows of a group whose texts have one form but differ in code points, smaller id first.

    Texts are made distinct before anything is paired, so copies of a text cost one row; only forms with more than one
    spelling are joined back to rows. The rows of a large class are dealt into parts, and each pair of parts is a key of its own.
    Rows with a null id or text are in no pair; repeated rows give a pair once.
    """
    named, spelled = _spellings(rows, key, text, group)
    several = spelled.groupBy("g", "form").agg(F.collect_list("t").alias("ts"), F.sum("n").alias("n")).where("size(ts) > 1")
    # A row for each spelling, with the form's number in place of its text.
    labelled = several.select("g", F.xxhash64("g", "form").alias("h"), "form", F.ceil(F.col("n") / PAIRED).cast("int").alias("parts"), F.explode("ts").alias("t"))
    members = named.join(labelled, ["g", "t"]).select("g", "h", "form", "t", "id", "parts").distinct()
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    a = members.withColumn("x", part).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("a")
    b = members.withColumn("y", part).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.form") == F.col("b.form"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.t") != F.col("b.t"))).select(F.col("a.g").alias("group"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
