"""The text-normalisation rules R01 to R18, each a column expression, and the pipeline of all of them.

Rules that built-in expressions can't express (compatibility normalisation,
the paragraph fold) share one Arrow function for each stretch of the pipeline.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scanloom.functions.patterns import SPACE, WORD, let, lines, strip, without_last_blank, word_count, words
from scanloom.session import spread

# Fixed values of the rules.
CONTROL = "​-‏‪-‮﻿"
DIACRITICS = "\u064b-\u0652"
PUNCTUATION_FROM, PUNCTUATION_TO = "‚„“”‘’«»", ",\"\"\"''\"\""
QUOTES_FROM, QUOTES_TO = "“”„«»‘’‚", "\"\"\"\"\"'''"
LAM_ALEF = {"ﻻ": "لا", "ﻷ": "لأ", "ﻹ": "لإ", "ﺁ": "آ"}
MARKERS = ("⚠", "✔", "✖", "❌", "✅", "🔴", "🟢", "🟡", "⭐", "★", "※", "†", "‡")
UNCERTAIN = "[؟؟]"
BULLETS = "•▪◦·*"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PAGE_NUMBER = rf"^[{SPACE}]*[-–—]?[{SPACE}]*\p{{Nd}}{{1,4}}[{SPACE}]*[-–—]?[{SPACE}]*$"
FOOTNOTE = rf"^[{SPACE}]*([¹²³⁴⁵⁶⁷⁸⁹]|\p{{Nd}}{{1,2}}|\(\p{{Nd}}{{1,2}}\)|\[\p{{Nd}}{{1,2}}\])[{SPACE}]+"
SENTENCE_END = rf"[.!؟?…:؛]\"?[{SPACE}]*$"
VALID_WORD = r"^[\x{0621}-\x{064a}a-zA-Z0-9.,;:!?()\[\]\"'«»،؛؟-]+$"
VALID_CHARACTERS = "".join(map(chr, range(0x621, 0x64B))) + "".join(map(chr, range(0x30, 0x3A))) + "".join(map(chr, range(0x41, 0x5B))) + "".join(map(chr, range(0x61, 0x7B))) + ".,;:!?()[]\"'«»،؛؟-"
CONFIDENCE_THRESHOLD, VALID_RATIO, HEADING_WORDS, FLOWING_WORDS, HEADER_LINES, HEADER_REPEATS, HEADER_CHARS = 0.80, 0.85, 12, 7, 6, 3, 80
FOOTNOTE_HEADING = "\n\n---\n\n## الحواشي\n\n"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


# Kept apart from the expressions around them, in whose array functions Python can't run.
_nfkc, _nfc = _nfkc.asNondeterministic(), _nfc.asNondeterministic()


def nfc(c: Column) -> Column:
    return _nfc(c)


def strip_control(c: Column) -> Column:
    """Zero-width and direction characters removed."""
    return F.regexp_replace(c, f"[{CONTROL}]", "")


def unify_forms(c: Column) -> Column:
    """Unicode compatibility composition."""
    return _nfkc(c)


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces, tabs and no-break spaces to one space, three and more line feeds to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t ]+", " "), "\n{3,}", "\n\n"))


def join_hyphenated(c: Column) -> Column:
    """A word broken by a hyphen at a line end is joined."""
    return F.regexp_replace(c, rf"([{WORD}])-[{SPACE}]*\n[{SPACE}]*([{WORD}])", "$1$2")


_STRUCTURE = re.compile(rf"-|##|\d{{1,2}}\s|\(\d{{1,2}}\)|[{BULLETS}]")
_ENDED = re.compile(r'[.!؟?…:؛]"?\s*$')


def merge_lines(text: str) -> str:
    """R05 on one text: a line is appended to running text of seven words or more that has not ended."""
    out: list[str] = []
    held: list[str] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if held:
            out.append(" ".join(held))
            held.clear()
        count = 0

    for line in map(str.strip, text.splitlines()):
        if not line:
            flush()
            out.append("")
            continue
        structural = _STRUCTURE.match(line) is not None
        # What is held has not ended, else it would have been let go.
        if structural or count < FLOWING_WORDS:
            flush()
        held.append(line)
        count += len(line.split())
        if structural or _ENDED.search(line):
            flush()
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def _merged(s: pd.Series) -> pd.Series:
    return s.map(merge_lines, na_action="ignore")


_merged = _merged.asNondeterministic()


def merge_paragraphs(c: Column) -> Column:
    """Broken lines of a paragraph merged."""
    return _merged(c)


def _no_page_numbers(a: Column) -> Column:
    return F.filter(a, lambda x: ~x.rlike(PAGE_NUMBER))


def drop_page_numbers(c: Column) -> Column:
    """Lines that hold a page number only are dropped."""
    return F.array_join(_no_page_numbers(lines(c)), "\n")


def page_number_lines(c: Column) -> Column:
    """How many lines R06 drops."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(PAGE_NUMBER)))


def _no_headers(a: Column) -> Column:
    """The lines of R07: in six lines or more the first and last one are dropped wherever they repeat three times; blank ones go too then."""

    def without(a: Column, line: Column) -> Column:
        repeated = (F.size(F.filter(a, lambda x: x == line)) >= HEADER_REPEATS) & (F.length(line) < HEADER_CHARS)
        return F.when(repeated, F.filter(a, lambda x: x != line)).otherwise(a)

    def kept(full: Column) -> Column:
        ends = F.struct(F.try_element_at(full, F.lit(1)).alias("first"), F.try_element_at(full, F.lit(-1)).alias("last"))
        return let(ends, lambda e: let(without(full, e["first"]), lambda x: without(x, e["last"])))

    stripped = let(F.filter(F.transform(a, strip), lambda x: x != ""), lambda full: F.when(F.size(full) >= HEADER_LINES, kept(full)))
    return F.when(F.size(a) < HEADER_LINES, a).otherwise(F.coalesce(stripped, a))


def drop_headers(c: Column) -> Column:
    """In a text of six lines or more the first and last line are dropped wherever they repeat three times.

    Blank lines go too then; a shorter text is left as it is.
    """
    few = F.size(F.filter(lines(c), lambda x: strip(x) != "")) < HEADER_LINES
    return F.when(few, c).otherwise(F.array_join(_no_headers(lines(c)), "\n"))


def strip_diacritics(c: Column) -> Column:
    """Arabic vowel signs removed."""
    return F.regexp_replace(c, f"[{DIACRITICS}]", "")


def unify_alef(c: Column, taa_marbuta: bool = False) -> Column:
    """Forms of alef to plain alef, alef maqsura to yaa, and on request taa marbuta to haa."""
    return F.translate(c, "أإآى" + "ة" * taa_marbuta, "اااي" + "ه" * taa_marbuta)


def unify_digits(c: Column) -> Column:
    """Arabic-Indic digits to Western ones."""
    return F.translate(c, ARABIC_DIGITS, "0123456789")


def unify_punctuation(c: Column) -> Column:
    """Quotation marks and low quotes to plain ones, the ellipsis to three dots."""
    return F.replace(F.translate(c, PUNCTUATION_FROM, PUNCTUATION_TO), F.lit("…"), F.lit("..."))


def unify_quotes(c: Column) -> Column:
    """All quotation marks to straight ones."""
    return F.translate(c, QUOTES_FROM, QUOTES_TO)


def substitute_ligatures(c: Column) -> Column:
    """Lam-alef ligatures written out."""
    for a, b in LAM_ALEF.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markers_found(c: Column) -> Column:
    """The visual markers of a text, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(c, m)))


def isolate_markers(c: Column) -> Column:
    """Each visual marker in brackets."""
    for m in MARKERS:
        c = F.replace(c, F.lit(m), F.lit(f"[{m}]"))
    return c


def flag_uncertain(c: Column, confidence: Column) -> Column:
    """Below the confidence threshold, words of two characters or more that don't open a bracket get a flag."""
    flagged = F.regexp_replace(c, rf"(?<![^{SPACE}])([^{SPACE}\[][^{SPACE}]+)", f"$1{UNCERTAIN}")
    return F.when(confidence < CONFIDENCE_THRESHOLD, flagged).otherwise(c)


def uncertain_count(c: Column, confidence: Column) -> Column:
    """How many words R15 flags."""
    hit = F.filter(words(c), lambda w: (F.length(w) >= 2) & ~w.startswith("["))
    return F.when(confidence < CONFIDENCE_THRESHOLD, F.size(hit)).otherwise(0)


def valid_words(c: Column) -> Column:
    """How many words hold nothing but the letters, digits and signs of R16: all but those of which something is left without these."""
    return word_count(c) - word_count(F.translate(c, VALID_CHARACTERS, ""))


def valid_ratio(c: Column) -> Column:
    """The share of words of plain Arabic or Latin letters, digits and punctuation; 0 without words."""
    counts = F.struct(word_count(c).alias("all"), word_count(F.translate(c, VALID_CHARACTERS, "")).alias("other"))
    return let(counts, lambda n: F.when(n["all"] > 0, (n["all"] - n["other"]) / n["all"]).otherwise(0.0))


def classification(c: Column) -> Column:
    """R16: 'correct' where the share of valid words reaches the threshold, else 'wrong'."""
    return F.when(valid_ratio(c) >= VALID_RATIO, "correct").otherwise("wrong")


def markdown_structure(c: Column) -> Column:
    """Bullets to '- ', short lines without a sentence end to headings."""

    def shape(line: Column) -> Column:
        return let(strip(line), lambda s: shaped(line, s))

    def shaped(line: Column, s: Column) -> Column:
        few = rf"^[^{SPACE}]++(?:[{SPACE}]++[^{SPACE}]++){{0,{HEADING_WORDS - 1}}}+\z"
        heading = (s != "") & ~s.startswith("#") & ~s.endswith("-") & s.rlike(few) & ~s.rlike(SENTENCE_END)
        bullet = rf"^[{BULLETS}][{SPACE}]+"
        return F.when(s.rlike(bullet), F.concat(F.lit("- "), F.regexp_replace(s, bullet, ""))).when(heading, F.concat(F.lit("## "), s)).otherwise(line)

    return F.array_join(F.transform(lines(c), shape), "\n")


def footnotes(c: Column) -> Column:
    """The footnote lines of a text, stripped."""
    return F.array_join(F.transform(F.filter(lines(c), lambda x: x.rlike(FOOTNOTE)), strip), "\n")


def footnote_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(FOOTNOTE)))


def without_footnotes(c: Column) -> Column:
    """A text without its footnote lines."""
    return F.array_join(F.filter(lines(c), lambda x: ~x.rlike(FOOTNOTE)), "\n")


#: The rules in the order in which the pipeline applies them.
ORDER = ("R01", "R02", "R06", "R07", "R18", "R04", "R05", "R17", "R13", "R09", "R10", "R11", "R12", "R08", "R15", "R14", "R03", "R16")


@dataclass(frozen=True)
class RuleConfig:
    """Which rules run; a rule that is off is not in the plan."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(ORDER))
    taa_marbuta: bool = False

    @classmethod
    def from_rules(cls, rules: list[dict]) -> RuleConfig:
        """From a list of {id, enabled, params} entries, as a rule file holds them."""
        on = frozenset(r["id"] for r in rules if r.get("enabled", True))
        taa = any(r["id"] == "R09" and (r.get("params") or {}).get("unify_taa_marbuta") for r in rules)
        return cls(on, bool(taa))


def load_rules(path: str) -> RuleConfig:
    """Reads a rule file (YAML). A file without a ``rules`` list enables nothing."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return RuleConfig.from_rules(data.get("rules") or [])


def process_text(df: DataFrame, text: str, confidence: str | None = None, config: RuleConfig | None = None) -> DataFrame:
    """``df`` with the pipeline's results: markdown, classification, ratio (4 places) and metadata columns.

    Adds ``markdown``, ``ratio``, ``classification``, ``markers``, ``footnotes_count``,
    ``pages_dropped``, ``uncertain_flags``, ``had_diacritics``,
    ``had_arabic_digits`` and ``rules_applied``. Unknown confidence (null or 0)
    counts as certain. A null text gives nulls. Python runs twice at most, for
    R02 and for R05; all other rules stay in the JVM.
    """
    on = (config or RuleConfig()).enabled
    taa = (config or RuleConfig()).taa_marbuta
    conf = F.lit(1.0) if confidence is None else F.when(F.coalesce(F.col(confidence), F.lit(0.0)) > 0, F.col(confidence)).otherwise(1.0)
    out = spread(df).withColumn("_t", F.col(text)).withColumn("_conf", conf)

    def apply(rule: str, f) -> None:
        nonlocal out
        if rule in on:
            out = out.withColumn("_t", f(F.col("_t")))

    t = F.col("_t")
    apply("R01", strip_control)
    apply("R02", unify_forms)
    # R06, R07 and R18 look at lines: the text is split once and joined once.
    step, a = [r for r in ("R06", "R07", "R18") if r in on], F.col("_a")
    out = out.withColumn("pages_dropped", F.lit(0)).withColumn("_notes", F.lit("")).withColumn("footnotes_count", F.lit(0))
    if "R18" not in on:
        out = out.withColumn("pages_dropped", page_number_lines(t) if "R06" in on else F.lit(0))
        apply("R06", drop_page_numbers)
        apply("R07", drop_headers)
        step = []
    if step:
        out = out.withColumn("_a", lines(t))
    for k, rule in enumerate(step):
        if k:
            out = out.withColumn("_a", without_last_blank(a))
        if rule == "R06":
            out = out.withColumn("_kept", _no_page_numbers(a)).withColumn("pages_dropped", F.size(a) - F.size("_kept")).withColumn("_a", F.col("_kept")).drop("_kept")
        elif rule == "R07":
            out = out.withColumn("_a", _no_headers(a))
        else:
            notes = F.filter(a, lambda x: x.rlike(FOOTNOTE))
            out = out.withColumn("_n", notes).withColumn("_notes", F.array_join(F.transform("_n", strip), "\n")).withColumn("footnotes_count", F.size("_n"))
            out = out.withColumn("_a", F.when(F.size("_n") > 0, F.filter(a, lambda x: ~x.rlike(FOOTNOTE))).otherwise(a)).drop("_n")
    if step:
        out = out.withColumn("_t", F.array_join("_a", "\n")).drop("_a")
    apply("R04", join_hyphenated)
    apply("R05", merge_paragraphs)
    apply("R17", markdown_structure)
    apply("R13", substitute_ligatures)
    apply("R09", lambda c: unify_alef(c, taa))
    out = out.withColumn("had_arabic_digits", t.rlike(f"[{ARABIC_DIGITS}]"))
    apply("R10", unify_digits)
    apply("R11", unify_punctuation)
    apply("R12", unify_quotes)
    out = out.withColumn("had_diacritics", t.rlike(f"[{DIACRITICS}]"))
    apply("R08", strip_diacritics)
    out = out.withColumn("uncertain_flags", uncertain_count(t, F.col("_conf")) if "R15" in on else F.lit(0))
    apply("R15", lambda c: flag_uncertain(c, F.col("_conf")))
    out = out.withColumn("markers", markers_found(t) if "R14" in on else F.array().cast("array<string>"))
    apply("R14", isolate_markers)
    apply("R03", collapse_spaces)
    applied = F.array(*(F.lit(r) for r in ORDER if r in on)).cast("array<string>")
    out = out.withColumn("_r", valid_ratio(t)).withColumn("ratio", F.round("_r", 4)).withColumn("classification", F.when(F.col("_r") >= VALID_RATIO, "correct").otherwise("wrong"))
    out = out.withColumn("rules_applied", applied).drop("_r")
    notes = F.when(F.col("_notes") != "", F.concat(F.lit(FOOTNOTE_HEADING), F.col("_notes"))).otherwise("")
    return out.withColumn("markdown", F.concat(t, notes)).drop("_t", "_conf", "_notes")
