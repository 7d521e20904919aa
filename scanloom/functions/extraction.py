"""Clinical fields, sensitive data by pattern, markers, verdicts and table cells."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scanloom.functions.normalizers import strong
from scanloom.functions.patterns import SPACE, let, strip, words

# Label patterns of the fields; multi-line fields end at the next label or the end of the text.
_S = f"[{SPACE}]"
_SEP = rf"{_S}*[:：\-]?{_S}*"
_NEXT = (
    rf"(?=\n{_S}*(?:اسم{_S}*المريض|المريض|رقم{_S}*(?:الملف|المريض|الهوية)|التاريخ|تاريخ{_S}*الزيارة|اسم{_S}*الطبيب|الطبيب|التشخيص|الأدوية|العلاج|"
    rf"Patient{_S}*Name|Patient{_S}*ID|MRN|DOB|Date\b|Doctor|Dr\b|Diagnosis|Dx\b|Medications?\b|Rx\b){_S}*[:：\-]?|\n?\z)"
)
LABELS = {
    "patient_name": rf"(?:اسم{_S}*المريض|المريض|Patient{_S}*Name|Pt{_S}*Name){_SEP}([^\n]+)",
    "patient_id": rf"(?:رقم{_S}*(?:الملف|المريض|الهوية)|Patient{_S}*ID|MRN|ID|File{_S}*No){_SEP}([A-Z0-9\-/]{{3,}})",
    "date": rf"(?:التاريخ|تاريخ{_S}*الزيارة|Date|DOB|Visit{_S}*Date){_SEP}([0-9٠-٩\-/]{{6,}})",
    "doctor_name": rf"(?:اسم{_S}*الطبيب|الطبيب|Doctor|Dr){_SEP}([^\n]+)",
    "diagnosis": rf"(?:التشخيص|Diagnosis|Dx){_SEP}([\s\S]+?){_NEXT}",
    "medications": rf"(?:الأدوية|العلاج|Medications?|Rx){_SEP}([\s\S]+?){_NEXT}",
}
SENSITIVE = {
    "PATIENT_NAME": r"(?i)(?:patient\s+name|name)\s*[:\-]?\s*.+?(?:\n|\z)",
    "DATE_OF_BIRTH": r"(?i)(?:date\s+of\s+birth|dob|تاريخ\s+الميلاد)\s*[:\-]?\s*.+?(?:\n|\z)",
    "PHONE": r"\b(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "MRN": r"\b(?:MRN|mrn)\s*[:\-]?\s*\d{4,}\b",
    "DATE": r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b",
}
CORRECT_MARKS, INCORRECT_MARKS = ("✓", "✔", "☑"), ("✗", "✘", "X", "x", "✖", "❌")
CONTEXT_WORDS = {
    "correct": ("correct", "right", "صحيح", "صواب", "الترجمة الصحيحة"),
    "incorrect": ("incorrect", "wrong", "error", "خطأ", "خاطئ", "الترجمة الخاطئة"),
    "revision": ("correction", "revised", "suggested translation", "التصحيح", "مقترح", "مراجعة"),
}
CHECKS = (
    "tables_preserved", "column_order_preserved", "images_captured", "markers_captured", "color_semantics_preserved", "correct_incorrect_separated",
    "error_examples_flagged", "uncertainty_flagged", "no_silent_correction", "training_safety_verified", "original_reference_traceable",
)


def clean_value(c: Column) -> Column:
    """Spaces collapsed; blanks, hyphens, colons and direction marks stripped from both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{_S}+", " "), "^[ \\-:‏‎]+|[ \\-:‏‎]+$", "")


def labelled(c: Column, name: str) -> Column:
    """The first value after a field's label in the raw text; '' if none."""
    return clean_value(F.regexp_extract(c, "(?iud)" + LABELS[name], 1))


def labelled_or_normalised(c: Column, name: str) -> Column:
    """Like ``labelled``, and where nothing is found the same in the strongly normalised text, whose lines are one."""
    return let(labelled(c, name), lambda v: F.when(v != "", v).otherwise(labelled(F.col("_strong"), name)))


def with_fields(df: DataFrame, text: str, name: str = "fields") -> DataFrame:
    """``df`` with a struct of all fields, raw text first, then the normalised one."""
    out = df.withColumn("_strong", strong(F.col(text)))
    t = F.col(text)
    one = [labelled_or_normalised(t, n).alias(n) for n in LABELS if n != "medications"]
    meds = labelled_or_normalised(t, "medications")
    return out.withColumn(name, F.struct(*one, medication_list(meds).alias("medications"))).drop("_strong")


def medication_list(c: Column) -> Column:
    """The medications of a captured field: cut at commas, semicolons and line feeds, cleaned, blank ones dropped."""
    return F.filter(F.transform(F.split(c, rf"{_S}*[،,؛;\n]{_S}*"), clean_value), lambda m: m != "")


def fields(c: Column) -> Column:
    """struct of all fields of a text; medications as a list."""
    one = [labelled(c, n).alias(n) for n in LABELS if n != "medications"]
    return F.struct(*one, medication_list(F.regexp_extract(c, "(?iud)" + LABELS["medications"], 1)).alias("medications"))


def field_confidence(value: Column, name: str) -> Column:
    """How plausible a value is by its length and form; 0 for an empty one; 3 places."""
    n = F.length(value)
    base = F.when(n < 3, 0.3).otherwise(F.least(F.lit(0.95), 0.5 + 0.05 * n))
    if name == "patient_id":
        base = F.when(value.rlike(r"^[A-Za-z0-9\-/]{3,}$"), F.least(F.lit(0.95), base + 0.1)).otherwise(F.greatest(F.lit(0.2), base - 0.2))
    if name in ("diagnosis", "medications"):
        base = F.least(F.lit(0.95), base + 0.05 * (F.size(words(value)) - 1))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.round(base, 3))


def patient_fingerprint(name: Column, patient: Column, date: Column, doctor: Column) -> Column:
    """SHA-1 of name, id, date and doctor joined by pipes, '' where all are empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (name, patient, date, doctor)]
    joined = F.concat_ws("|", *parts)
    return F.when(F.concat(*parts) == "", "").otherwise(F.sha1(joined))


def template_signature(c: Column, values: Column) -> Column:
    """What is left of a text without its values: values removed, longest first, digits to #, what follows a label cut, blank lines dropped."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda a, b: F.length(b) - F.length(a))
    bare = F.aggregate(ordered, c, lambda acc, v: F.replace(acc, v, F.lit("")))
    cut = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"{_S}*[:：\-]{_S}*.+$", ""), r"\p{Nd}", "#"))
    return F.array_join(F.filter(F.transform(cut, strip), lambda x: x != ""), "\n")


def sensitive_counts(c: Column) -> Column:
    """struct of the number of matches of each pattern."""
    return F.struct(*(F.regexp_count(c, F.lit(p)).alias(n) for n, p in SENSITIVE.items()))


_ENTITY = ArrayType(StructType([StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))
_PATTERNS = [(n, re.compile(p.replace(r"\z", r"\Z"))) for n, p in SENSITIVE.items()]


def entities_of(text: str) -> list[tuple[str, int, int]]:
    """Matches of all patterns in order; of overlapping ones the earlier, then the longer stays."""
    found = sorted(((n, m.start(), m.end()) for n, p in _PATTERNS for m in p.finditer(text)), key=lambda e: (e[1], -e[2]))
    out: list[tuple[str, int, int]] = []
    for e in found:
        if not out or e[1] >= out[-1][2]:
            out.append(e)
    return out


def sensitive_entities(c: Column) -> Column:
    """The matches with their places; null for null."""

    @F.pandas_udf(_ENTITY)
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"label": n, "start": a, "end": b, "text": t[a:b]} for n, a, b in entities_of(t)], na_action="ignore")

    return find(c)


def masked(c: Column, how: str = "tag") -> Column:
    """Sensitive data by pattern replaced: 'tag' by [LABEL], 'replace' by stars, 'redact' by nothing."""
    by = {"tag": lambda n, t: f"[{n}]", "replace": lambda n, t: "*" * len(t), "redact": lambda n, t: ""}[how]

    @F.pandas_udf(StringType())
    def mask(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for n, a, b in reversed(entities_of(t)):
                t = t[:a] + by(n, t[a:b]) + t[b:]
            return t

        return s.map(one, na_action="ignore")

    return mask(c)


def marker_status(marks: Column) -> Column:
    """struct(status, x_warning) of a list of detected marks."""
    right, wrong = F.arrays_overlap(marks, F.array(*map(F.lit, CORRECT_MARKS))), F.arrays_overlap(marks, F.array(*map(F.lit, INCORRECT_MARKS)))
    status = F.when(right & wrong, "uncertain").when(right, "correct").when(wrong, "incorrect").otherwise("neutral")
    return F.struct(status.alias("status"), F.when(F.array_contains(marks, "X"), "X_REQUIRES_CONTEXT_CHECK").alias("x_warning"))


def context_of(c: Column) -> Column:
    """Which kind of key word dominates a text: correct, incorrect, mixed, revision or null."""
    low = F.lower(c)

    def any_of(k: str) -> Column:
        hit = F.lit(False)
        for w in CONTEXT_WORDS[k]:
            hit = hit | F.contains(low, F.lit(w))
        return hit

    right, wrong = any_of("correct"), any_of("incorrect")
    return F.when(right & wrong, "mixed").when(right, "correct").when(wrong, "incorrect").when(any_of("revision"), "revision")


def verdict(checks: Column) -> Column:
    """struct(verdict, score, missing) of a map of check to boolean, over the full list of checks."""
    names = F.array(*map(F.lit, CHECKS))
    missing = F.filter(names, lambda n: ~F.coalesce(checks[n], F.lit(False)))
    score = 1 - F.size(missing) / len(CHECKS)
    v = F.when(score == 1.0, "PASS").when(score >= 0.7, "PARTIAL").when(score >= 0.4, "UNCERTAIN").otherwise("FAILED")
    return F.struct(v.alias("verdict"), F.round(score, 4).alias("score"), missing.alias("missing"))


def cells(c: Column) -> Column:
    """The cells of a line of a table: cut at tabs, else pipes, else white space."""
    parts = F.when(F.contains(c, F.lit("\t")), F.split(c, "\t")).when(F.contains(c, F.lit("|")), F.filter(F.split(c, r"\|"), lambda x: strip(x) != "")).otherwise(words(c))
    return F.transform(parts, strip)


def cell_match(expected: Column, predicted: Column) -> Column:
    """'ok' within 5 % for numbers or equal but for case, else 'missing', 'numeric_mismatch', 'minor_typo' (over 70 % of places equal) or 'major_error'."""
    a, b = strip(expected).try_cast("double"), strip(predicted).try_cast("double")
    near = F.abs(a - b) <= 0.05 * F.abs(a)
    size = F.greatest(F.length(expected), F.length(predicted))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), size)), lambda i: F.substring(expected, i, F.lit(1)) == F.substring(predicted, i, F.lit(1))))
    return (
        F.when(F.coalesce(strip(predicted), F.lit("")) == "", F.when(F.coalesce(strip(expected), F.lit("")) == "", "ok").otherwise("missing"))
        .when(a.isNotNull() & b.isNotNull(), F.when(near, "ok").otherwise("numeric_mismatch"))
        .when(F.lower(strip(expected)) == F.lower(strip(predicted)), "ok").when(same / size > 0.7, "minor_typo").otherwise("major_error")
    )
