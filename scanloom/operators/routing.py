"""Which engines to run on a page, and which of their results to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.metrics import composite
from scanloom.functions.patterns import let

# Memory of the engines in GB, seconds a page on a GPU, and engines of the profiles.
MEMORY = {"Tesseract": 0.5, "EasyOCR": 1.5, "TrOCR": 3.5, "PaddleOCR": 4.0, "Arabic-handwritten-OCR (Qwen)": 5.5, "QARI": 4.5, "Nougat": 4.5}
SECONDS = {"Tesseract": 0.4, "EasyOCR": 1.5, "TrOCR": 2.5, "PaddleOCR": 2.0, "Arabic-handwritten-OCR (Qwen)": 3.4, "QARI": 2.8, "Nougat": 3.2}
PROFILES = {
    "low": ("Tesseract", "EasyOCR"),
    "balanced": ("EasyOCR", "Tesseract", "TrOCR", "Arabic-handwritten-OCR (Qwen)", "QARI"),
    "high": ("EasyOCR", "Tesseract", "TrOCR", "PaddleOCR", "Arabic-handwritten-OCR (Qwen)", "QARI", "Nougat"),
}
WITHOUT_GPU = 1.8
CONFIDENT = 0.0


def select_engines(profile: str, quality: Column, language: Column, block: Column, diacritics: Column, document: Column, structured: Column, memory: Column, most: int = 3) -> Column:
    """The engines for a page in order of preference, as an array.

    Candidates are named by block, script, structure and quality, kept if the
    profile has them, taken while they fit the memory left (a later, smaller one
    may still fit) and cut to ``most``. Nothing left gives Tesseract.
    """
    allowed = PROFILES[profile]
    if profile == "low":
        return F.array(F.lit("Tesseract"))

    def named(when: Column, *names: str) -> Column:
        return F.when(when, F.array(*(F.lit(n) for n in names if n in allowed)).cast("array<string>")).otherwise(F.array().cast("array<string>"))

    arabic, latin = language.isin("ar", "mixed"), language.isin("en", "de")
    parts = [
        F.slice(named(block == "handwriting", "Arabic-handwritten-OCR (Qwen)", "QARI", "TrOCR"), 1, most),
        named(diacritics & arabic, "QARI"),
        named(structured | block.isin("table", "form") | document.isin("report", "article", "book", "markdown"), "Nougat"),
        named(arabic, "EasyOCR"),
        named(quality < 0.60, "Tesseract"),
        named(arabic if profile == "high" else F.lit(False), "PaddleOCR"),
        named(latin & (quality >= 0.75), "TrOCR", "EasyOCR"),
    ]

    def fitting(c: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("chosen"), memory.cast("double").alias("left"))
        need = F.create_map(*(F.lit(x) for kv in MEMORY.items() for x in kv))
        step = lambda s, e: F.when(need[e] <= s["left"], F.struct(F.array_append(s["chosen"], e).alias("chosen"), (s["left"] - need[e]).alias("left"))).otherwise(s)
        return F.aggregate(c, start, step)["chosen"]

    candidates = let(F.array_distinct(F.concat(*parts)), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("EasyOCR"), F.lit("Tesseract"))))
    return let(candidates, lambda c: let(fitting(c), lambda f: F.when(F.size(f) > 0, F.slice(f, 1, most)).otherwise(F.array(F.lit("Tesseract")))))


def seconds_per_page(engines: Column, gpu: bool = False) -> Column:
    """The summed estimate for a list of engines, one place."""
    table = F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv))
    return F.round(F.aggregate(engines, F.lit(0.0), lambda s, e: s + F.coalesce(table[e], F.lit(0.0))) * (1.0 if gpu else WITHOUT_GPU), 1)


def best_results(results: DataFrame, page: str) -> DataFrame:
    """(page, ``engine``, ``text``, ``confidence``, ``composite``): the winner of each page.

    Rows with an error and no text are out. Those with a known confidence are
    preferred to the others; within a tier the highest composite wins, and of
    equals the last name. A page of failures only gets no row.
    """
    ok = results.where(F.col("error").isNull() | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    value = composite(F.col("confidence"), F.coalesce(F.col("text"), F.lit("")), F.col("error").isNotNull())
    scored = ok.withColumn("composite", value)
    best = F.max_by(F.struct("engine", "text", "confidence", "composite"), F.struct((F.col("confidence") > CONFIDENT).alias("t"), F.round("composite", 9).alias("c"), F.col("engine").alias("e")))
    return scored.groupBy(page).agg(best.alias("b")).select(page, "b.*")
