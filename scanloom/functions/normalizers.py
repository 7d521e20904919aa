"""Named text normalisers and the right-to-left repair."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scanloom.functions.patterns import SPACE, WORD, let, strip, words
from scanloom.functions.text_rules import nfc

# Fixed values of the normalisers.
SIGNS_BASIC = "\u0617-\u061a\u064b-\u0652"
SIGNS_V1 = "\u064b-\u065f\u0670"
SIGNS_CI = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed"
EXTENDED_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ARABIC_BLOCKS = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
REVERSAL_HINTS = ("ال", "اسم", "الم", "مريض", "تاريخ", "رقم", "تشخيص", "دواء", "عبد", "بن", "ية", "ات")
REVERSED_SHARE = 0.30
MEDICAL_WORDS = {
    "مغ": "ملغ", "ص": "صباحا", "م": "مساء", "لوزتين": "اللوزتين", "اموكسيسيلين": "أموكسيسيلين", "ايبوبروفين": "إيبوبروفين",
    "باراسيتامول": "باراسيتامول", "اموكلاف": "أموكسيسيلين/كلافولانات",
}
CORRECTIONS = {
    "lisinoprl": "lisinopril", "atenolol": "atenolol", "metformn": "metformin", "atorvastatn": "atorvastatin", "aspirn": "aspirin", "adenocarcnoma": "adenocarcinoma", "chemothrapy": "chemotherapy", "myocardal": "myocardial",
    "infarcton": "infarction", "pneumnia": "pneumonia", "bronchits": "bronchitis", "hypertnsion": "hypertension", "diabetes": "diabetes", "hypoglycmia": "hypoglycemia", "arrhythmia": "arrhythmia",
    "palpitatons": "palpitations", "thrombosis": "thrombosis", "embolism": "embolism", "edema": "edema", "anemia": "anemia",
}
UNITS = r"(?:mg|mcg|ug|ml|iu|g|kg|mm|cm|mmol|°C|%|ملغ|ميكروغرام|مكغ|مل|جم|كجم|غرام|كيلوغرام|سم|مم|مليمول|وحدة دولية)"


def _digits(c: Column, extended: bool = False) -> Column:
    return F.translate(c, ARABIC_DIGITS + EXTENDED_DIGITS * extended, "0123456789" * (1 + extended))


def basic(c: Column) -> Column:
    """Composed, without signs and tatweel, alef and yaa and taa marbuta unified, spaces collapsed, Western digits, punctuation but . - ، ؛ dropped."""
    c = F.regexp_replace(nfc(c), f"[{SIGNS_BASIC}]", "")
    c = F.translate(c, "إأٱآىةـ", "اااايه")
    c = _digits(F.regexp_replace(c, f"[{SPACE}]+", " "))
    return strip(F.regexp_replace(c, rf"[^{WORD}{SPACE}.\-،؛]", ""))


def strong(c: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Like ``basic``, with a lookup of each word in a dictionary and more punctuation kept.

    Words are looked up lower-cased after letters were unified, so keys with
    hamza or capitals are never met; values are inserted as they are.
    """
    d = MEDICAL_WORDS if dictionary is None else dictionary
    c = F.regexp_replace(nfc(c), f"[{SIGNS_BASIC}]", "")
    c = F.translate(c, "إأٱآىةـ", "اااايه")
    c = strip(_digits(F.regexp_replace(c, f"[{SPACE}]+", " ")))
    if d:
        table = F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
        c = F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(table[F.lower(w)], w)), " ")
    return strip(F.regexp_replace(c, rf"[^{WORD}{SPACE}.\-،؛؟:()]", ""))


def version_1(c: Column, fold_hamza: bool = False) -> Column:
    """The evaluation normaliser; compatibility forms of the Arabic presentation blocks only."""
    c = F.translate(c, *_presentation_table())
    for a, b in _presentation_long().items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(F.regexp_replace(c, "[​-‏‪-‮﻿]", ""), f"[{SIGNS_V1}ـ]", "")
    c = F.translate(_digits(c, True), "،؟؛", ",?;")
    if fold_hamza:
        c = F.translate(c, "أإآٱؤئ", "اااا" + "وي")
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def _presentation() -> dict[str, str]:
    out = {}
    for code in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)):
        t = unicodedata.normalize("NFKC", chr(code))
        if t != chr(code):
            out[chr(code)] = t
    return out


def _presentation_table() -> tuple[str, str]:
    one = {a: b for a, b in _presentation().items() if len(b) == 1}
    return "".join(one), "".join(one.values())


def _presentation_long() -> dict[str, str]:
    """Lam-alef ligatures; longer ones are words and left to the compatibility rule."""
    return {a: b for a, b in _presentation().items() if len(b) == 2 and b[0] == "ل" and b[1] in "اأإآ"}


def for_ci(c: Column) -> Column:
    """Composed, lower case, spaces collapsed, all but word characters, spaces and the Arabic blocks dropped."""
    c = strip(F.regexp_replace(F.lower(nfc(c)), f"[{SPACE}]+", " "))
    return F.regexp_replace(c, rf"[^{WORD}{SPACE}؀-ۿݐ-ݿ]", "")


def arabic_for_ci(c: Column) -> Column:
    """Alef with hamza or madda, yaa and taa marbuta unified, signs dropped."""
    return F.regexp_replace(F.translate(c, "أإآىة", "اااي" + "ه"), f"[{SIGNS_CI}ـ]", "")


def for_matching(c: Column) -> Column:
    """Signs dropped, alef with hamza or madda, yaa and taa marbuta unified; punctuation, digits and spaces stay."""
    return F.translate(F.regexp_replace(c, "[\u064b-\u0652\u0670]", ""), "أإآىة", "ااا" + "يه")


def plain_words(c: Column) -> Column:
    """Runs of Arabic or ASCII letters and digits."""
    return F.regexp_extract_all(c, F.lit("([؀-ۿݐ-ݿa-zA-Z0-9]+)"), F.lit(1))


def cleaned(c: Column) -> Column:
    """Spaces collapsed, and single . _ - dropped that touch no digit."""
    c = F.regexp_replace(c, f"[{SPACE}]+", " ")
    return strip(F.regexp_replace(c, r"(?<![\p{Nd}._-])[._-](?![\p{Nd}._-])", ""))


def corrected_words(c: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Each white-space separated word replaced by its entry, found in lower case; an entry of itself gives its own case."""
    table = F.create_map(*(F.lit(x) for kv in (dictionary or CORRECTIONS).items() for x in kv))
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(table[F.lower(w)], w)), " ")


def replaced_substrings(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(text, hits): each wrong string replaced in order; hits counts the entries that were found."""
    hits = F.lit(0)
    for a, b in pairs:
        hits = hits + F.contains(c, F.lit(a)).cast("int")
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.struct(c.alias("text"), hits.alias("hits"))


_DOSE = re.compile(rf"(?<![\w.])(?:\d+(?:[.,]\d+)?|[٠-٩]+(?:[.,][٠-٩]+)?)[  ]?{UNITS}(?!\w)", re.I)
_VIEW = (
    ("remove_diacritics", re.compile("[\u064b-\u065f\u0670]"), ""), ("unify_alef", re.compile("[أإآٱ]"), "ا"), ("unify_alef_maqsura", re.compile("ى"), "ي"), ("remove_tatweel", re.compile("ـ+"), ""),
    ("unify_arabic_digits", re.compile("[٠-٩]"), lambda m: str(ord(m[0]) - 0x660)), ("unify_taa_marbuta", re.compile("ة"), "ه"),
)
_CHANGES = StructType([StructField("text", StringType()), StructField("changes", ArrayType(StructType([StructField("rule", StringType()), StructField("cnt", IntegerType())])))])


def view_of(text: str, taa_marbuta: bool = False, protect: bool = True) -> tuple[str, list[tuple[str, int]]]:
    """N11 on one text: the matching form and how often each rule changed something. Doses keep their characters."""
    text = unicodedata.normalize("NFC", text)
    doses: list[str] = []
    if protect:
        text = _DOSE.sub(lambda m: f"\0{doses.append(m[0]) or len(doses) - 1}\0", text)
    changes = []
    for name, pattern, by in _VIEW:
        if name == "unify_taa_marbuta" and not taa_marbuta:
            continue
        text, n = pattern.subn(by, text)
        if n:
            changes.append((name, n))
    text = re.sub("\0(\\d+)\0", lambda m: doses[int(m[1])], text)
    tidy = re.sub(r"\s+", " ", text).strip()
    if tidy != text:
        changes.append(("collapse_whitespace", 1))
    return tidy, changes


def matching_view(c: Column, taa_marbuta: bool = False, protect: bool = True) -> Column:
    """struct(text, changes)."""

    @F.pandas_udf(_CHANGES)
    def view(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else view_of(t, taa_marbuta, protect) for t in s]
        return pd.DataFrame({"text": [r[0] for r in rows], "changes": [None if r[1] is None else [{"rule": a, "cnt": n} for a, n in r[1]] for r in rows]})

    return view(c)


def _hint_score(w: Column) -> Column:
    score = F.when(w.startswith("ال"), 2).otherwise(0)
    for h in REVERSAL_HINTS:
        score = score + F.contains(w, F.lit(h)).cast("int")
    return score


def reversal_ratio(c: Column) -> Column:
    """The share of Arabic words of three letters or more that look more familiar read backwards; 0 without such words."""
    arabic = F.filter(words(c), lambda w: (F.length(w) >= 3) & w.rlike(f"^[{ARABIC_BLOCKS}]+$"))
    return let(arabic, lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: _hint_score(F.reverse(w)) > _hint_score(w))) / F.size(a)).otherwise(0.0))


_ARABIC_WORD = re.compile(f"[{ARABIC_BLOCKS}]+")


def turn_line(line: str) -> str:
    """Arabic words of a line turned round, each and in their order among the Arabic places."""
    parts = line.split()
    slots = [i for i, w in enumerate(parts) if _ARABIC_WORD.fullmatch(w)]
    turned = [parts[i][::-1] for i in slots]
    for i, w in zip(slots, reversed(turned) if len(turned) > 1 else turned):
        parts[i] = w
    return " ".join(parts)


def repair_direction(c: Column, force: bool = False) -> Column:
    """Texts whose Arabic came out backwards, turned line by line; others keep their text.

    Presentation forms of Arabic, which are written in the order of display, show that it did.
    """
    ratio = F.when(c.rlike("[ﭐ-﷿ﹰ-﻾]"), 1.0).otherwise(reversal_ratio(c))

    @F.pandas_udf(StringType())
    def fix(s: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(s, r):
            if t is None:
                out.append(None)
                continue
            t = unicodedata.normalize("NFKC", t)
            out.append("\n".join(map(turn_line, t.splitlines())).strip() if force or x >= REVERSED_SHARE else t)
        return pd.Series(out)

    return fix(c, ratio)
