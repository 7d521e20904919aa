"""Evaluation of recognised texts: rates after normalisation, terms, mixed directions, tables, summaries, training records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import metrics as M
from scanloom.functions import normalizers as N
from scanloom.functions.extraction import cell_match
from scanloom.functions.patterns import SPACE, let, strip

#: Terms that are sent to every task, at most; a longer list is refused.
MAX_TERMS = 100_000
#: A term counts as recognised within this many edits or at this likeness.
TERM_EDITS, TERM_LIKENESS, WORD_RATIO = 2, 0.85, 80.0
#: Error rates below which a case passes, by kind of benchmark.
PASS_BELOW = {"noise": 0.20, "specialty": 0.18, "neat": 0.10, "average": 0.15, "messy": 0.25, "scrawled": 0.35}
# Labels of the charter, pairs that must stay apart, labels that are never a target, checks that block.
ALLOWED_LABELS = ("positive_example", "negative_example", "example_of_error", "incorrect_example", "visual_correction_example", "uncertain", "neutral")
NEVER_TARGETS = ("negative_example", "example_of_error", "incorrect_example", "uncertain")
BLOCKING_CHECKS = ("no_silent_correction", "training_safety_verified", "original_reference_traceable")
# Misread units and digits, in the order in which they are put right.
CONFUSED = (
    (r"\bm[757]\b", "ملغ"), (r"\b[757]g\b", "ملغ"), (r"(\d+)\s*[مm][757]", r"\1 ملغ"), (r"(\d{2,4})\s*[مm][757]", r"\1 ملغ"), (r"(\d+)\s*m[l1]", r"\1 مل"), (r"(\d+)\s*c[0oO]m(?!\w)", r"\1 سم"),
    (r"(\d+)\s*m[مm]{2}(?!\w)", r"\1 مم"), (r"3[77][\.\s]*[cCس]", "37 درجة مئوية"), (r"\b(?=[0-9oO]*\d[0-9oO]*(?![0-9Oo]))[0-9oO]+(?![0-9Oo])", "zeros"), (r"\b1V\b", "IV"), (r"\b7ab(?!\w)", "tab"),
)
_CONFUSED = [(re.compile(p), (lambda m: m[0].translate({79: "0", 111: "0"})) if r == "zeros" else r) for p, r in CONFUSED]


def ci_rates(ref: Column, hyp: Column) -> Column:
    """struct(cer, wer): character and word edits after the continuous-integration normaliser."""
    a, b = N.for_ci(ref), N.for_ci(hyp)
    words = lambda c: F.array_join(N.plain_words(c), " ")
    return F.struct(M.cer(a, b)["cer"].alias("cer"), M.wer(words(a), words(b))["wer"].alias("wer"))


def eval_normalised(c: Column) -> Column:
    """Signs dropped, alef with hamza or wasla and alef maqsura unified, spaces collapsed; null gives ''."""
    c = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[ً-ٰٟ]", ""), "إأٱى", "اااي")
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def digits_and_letters(c: Column) -> Column:
    """Units and digits misread for each other put right by ordered patterns."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for pattern, by in _CONFUSED:
                t = pattern.sub(by, t)
            return t

        return s.map(one, na_action="ignore")

    return fix(c)


def phrases(c: Column, terms: list[str]) -> Column:
    """array of struct(phrase, start, end): every place of every term whatever its case, the longest term first; overlaps stay."""
    compiled = [re.compile(re.escape(t), re.I) for t in sorted(terms, key=len, reverse=True)]

    @F.pandas_udf("array<struct<phrase:string,start:int,end:int>>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"phrase": m[0], "start": m.start(), "end": m.end()} for p in compiled for m in p.finditer(t)], na_action="ignore")

    return find(c)


def _listed(terms: DataFrame, term: str) -> list[str]:
    rows = terms.select(F.col(term).alias("t")).where("t is not null and t != ''").distinct().orderBy("t").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return [r["t"] for r in rows]


def term_accuracy(pairs: DataFrame, key: str, ref: str, hyp: str, terms: DataFrame, term: str) -> DataFrame:
    """(``key``, ``expected``, ``correct``, ``accuracy``): terms like a word of the reference, and how many are like a word of the other text.

    A word is like a term where they are equal or their ratio is 80 or more; it
    stands for the equal term, else the likest, of equals the first by name.
    Each different word is compared once with a list of bounded size. Without
    a term the accuracy is 0.
    """
    known = _listed(terms, term)
    by_size: dict[int, list[str]] = {}
    for t in known:
        by_size.setdefault(len(t), []).append(t)
    everything = frozenset(known)

    @F.pandas_udf("array<struct<term:string,best:boolean>>")
    def alike(s: pd.Series) -> pd.Series:
        def one(w: str) -> list[dict]:
            hits = [(1000.0, w)] if w in everything else []
            # Twice the shorter length over both is the most the ratio can be.
            for n in range(-(-len(w) * 2 // 3), len(w) * 3 // 2 + 1):
                hits += [(r, t) for t in by_size.get(n, ()) if t != w and (r := M.ratio(w, t)) >= WORD_RATIO]
            best = min(hits, key=lambda h: (-h[0], h[1]), default=None)
            return [{"term": t, "best": (r, t) == best} for r, t in hits]

        return s.map(one)

    def words(c: str) -> Column:
        both = F.concat_ws(" ", N.for_ci(F.col(c)), N.arabic_for_ci(F.col(c)))
        return F.array_distinct(N.plain_words(N.for_ci(both)))

    cut = pairs.select(key, words(ref).alias("r"), words(hyp).alias("h"))
    each = cut.select(key, F.explode("r").alias("w"), F.lit(True).alias("is_ref")).unionByName(cut.select(key, F.explode("h").alias("w"), F.lit(False).alias("is_ref")))
    matched = each.select("w").distinct().withColumn("m", alike("w")).where("size(m) > 0").select("w", F.explode("m").alias("m")).select("w", "m.term", "m.best")
    hits = each.join(matched, "w").groupBy(key, "term").agg(F.max(F.col("is_ref") & F.col("best")).alias("wanted"), F.max(~F.col("is_ref")).alias("held")).where("wanted")
    found = hits.groupBy(key).agg(F.count("*").alias("expected"), F.count_if("held").alias("correct"))
    out = pairs.select(key).join(found, key, "left").fillna(0, ["expected", "correct"])
    return out.withColumn("accuracy", F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")).otherwise(0.0))


def term_statuses(text: Column, terms: list[str]) -> Column:
    """array of struct(term, status, distance): 'exact', 'approximate' (within 2 edits or 0.85 alike of some run of words) or 'missing'."""
    cleaned = [t.strip().lower() for t in terms if t.strip()]

    def one(term: str) -> Column:
        d = F.when(F.contains(F.lower(text), F.lit(term)), 0).otherwise(M.best_window(F.lit(term), text))
        near = lambda x: F.when(F.contains(F.lower(text), F.lit(term)), "exact").when((x <= TERM_EDITS) | (1 - x / len(term) >= TERM_LIKENESS), "approximate").otherwise("missing")
        return let(d, lambda x: F.struct(F.lit(term).alias("term"), near(x).alias("status"), x.cast("int").alias("distance")))

    return F.array(*map(one, cleaned))


def mixed_direction(ref: Column, hyp: Column, segments: Column) -> Column:
    """struct(cer without spaces, direction_errors, segment_accuracy, numeric_preservation, mixed_word_errors) for segments of (text, dir)."""
    arabic, latin = "[^؀-ۿ]", "[^a-zA-Z0-9]"
    core = lambda c, p: F.regexp_replace(c, p, "")
    lost = lambda p: lambda s: (core(s["text"], p) != "") & ~F.contains(core(hyp, p), core(s["text"], p))
    errors = F.size(F.filter(segments, lambda s: ((s["dir"] == "rtl") & lost(arabic)(s)) | ((s["dir"] == "ltr") & lost(latin)(s))))
    tidy = lambda c: strip(F.regexp_replace(c, f"[{SPACE}]+", " "))
    kept = F.size(F.filter(segments, lambda s: (tidy(s["text"]) != "") & F.contains(hyp, tidy(s["text"]))))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{Nd}+\.?\p{Nd}*)"), F.lit(1))
    same = F.size(F.filter(numbers(ref), lambda n: F.array_contains(numbers(hyp), n)))
    mixed = lambda c: F.regexp_extract_all(c, F.lit("([؀-ۿ]+[a-zA-Z]+|[a-zA-Z]+[؀-ۿ]+)"), F.lit(1))
    one_way = lambda a, b: F.size(F.filter(mixed(a), lambda w: ~F.array_contains(mixed(b), w)))
    return F.struct(
        M.cer(F.replace(ref, F.lit(" "), F.lit("")), F.replace(hyp, F.lit(" "), F.lit("")))["cer"].alias("cer"), errors.alias("direction_errors"),
        F.when(F.size(segments) > 0, kept / F.size(segments)).otherwise(1.0).alias("segment_accuracy"),
        F.when(F.size(numbers(ref)) > 0, same / F.size(numbers(ref))).otherwise(1.0).alias("numeric_preservation"), (one_way(ref, hyp) + one_way(hyp, ref)).alias("mixed_word_errors"),
    )


def table_structure(expected: Column, predicted: Column) -> Column:
    """struct(rows_complete, row_completeness, header_preserved, structure_preserved) of two arrays of rows of cells.

    A row after the first is complete where each of its cells that is not blank
    is met by some cell of the predicted row; the header is preserved with 70 %
    of its columns, the structure with the header and over 0.8 of the rows.
    """

    def complete(row: Column, i: Column) -> Column:
        other = F.coalesce(F.get(predicted, i), F.array().cast("array<string>"))
        return F.forall(row, lambda c: (strip(c) == "") | F.exists(other, lambda p: cell_match(c, p) == "ok"))

    rows = F.size(F.filter(F.transform(expected, lambda row, i: (i > 0) & complete(row, i)), lambda x: x))
    n = F.greatest(F.lit(1), F.size(expected) - 1)
    width = lambda t: F.coalesce(F.size(F.get(t, F.lit(0))), F.lit(0))
    header = (F.size(predicted) > 0) & (width(expected) > 0) & (width(predicted) >= width(expected) * 0.7)
    return let(F.struct(rows.alias("r"), n.alias("n"), header.alias("h")), lambda x: F.struct(x["r"].alias("rows_complete"), (x["r"] / x["n"]).alias("row_completeness"), x["h"].alias("header_preserved"), (x["h"] & (x["r"] / x["n"] > 0.8)).alias("structure_preserved")))


def noted_summary(df: DataFrame, notes: str, cer: str, limit: float) -> DataFrame:
    """(``category``, cases, avg_cer, passed, pass_rate) by the first value in ``notes``, such as 'noise_type=blur, difficulty=2'."""
    category = F.when(F.contains(F.col(notes), F.lit("=")), F.regexp_extract(notes, "=([^=,]*)", 1)).otherwise("unknown")
    out = df.select(category.alias("category"), F.col(cer).alias("c")).groupBy("category")
    return out.agg(F.count("*").alias("cases"), F.round(F.avg("c"), 4).alias("avg_cer"), F.count_if(F.col("c") < limit).alias("passed"), F.round(F.count_if(F.col("c") < limit) / F.count("*"), 2).alias("pass_rate"))


def engine_averages(df: DataFrame, metrics: list[str], seconds: str, dims: list[str]) -> DataFrame:
    """Averages by engine, and by engine and each of ``dims``, with rows a second; columns a set leaves out are null. One shuffle."""
    sets = [[F.col("engine")], *([F.col("engine"), F.col(d)] for d in dims)]
    return df.groupingSets(sets, F.col("engine"), *(F.col(d) for d in dims)).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), *(F.avg(m).alias(f"avg_{m}") for m in metrics), (F.count("*") / F.nullif(F.sum(seconds), F.lit(0))).alias("throughput")
    )


def layout_choice(regions: DataFrame, scan: str, kind: str, mode: str = "AUTO") -> DataFrame:
    """``regions`` with the ``mode`` of their scan (table and text: COMPLEX, table: TABLES, else SIMPLE) and whether they are ``kept``.

    In TABLES only tables are kept, but all if there is none.
    """
    w = Window.partitionBy(scan)
    has = lambda k: F.coalesce(F.max(F.col(kind) == k).over(w), F.lit(False))
    chosen = F.when(has("table") & has("text"), "COMPLEX").when(has("table"), "TABLES").otherwise("SIMPLE") if mode == "AUTO" else F.lit(mode)
    out = regions.withColumn("_table", has("table")).withColumn("mode", chosen)
    return out.withColumn("kept", (F.col("mode") != "TABLES") | ~F.col("_table") | F.coalesce(F.col(kind) == "table", F.lit(False))).drop("_table")


def box_xywh(box: Column, corners: bool = False) -> Column:
    """struct(x, y, w, h) of whole numbers of a box of four values, or null where it is malformed; halves go to even."""
    a, b, c, d = (F.get(box, F.lit(k)).cast("double") for k in range(4))
    sound = (F.size(box) == 4) & ~(F.isnan(a) | F.isnan(b) | F.isnan(c) | F.isnan(d)) & (a >= 0) & (b >= 0)
    sound = sound & ((c > a) & (d > b) if corners else (c > 0) & (d > 0))
    w, h = (c - a, d - b) if corners else (c, d)
    return F.when(sound, F.struct(*(F.bround(v, 0).cast("int").alias(n) for v, n in ((a, "x"), (b, "y"), (w, "w"), (h, "h")))))


def marker_union(first: Column, *others: Column) -> Column:
    """All marks in the order in which they come first, X and x left out of the ``others``."""
    out = first
    for o in others:
        out = F.concat(out, F.filter(o, lambda m: ~m.isin("X", "x")))
    return F.array_distinct(out)


def colour_semantics(text: Column, colours: Column, legend_words: list[str], missing_label: str = "COLOR_SEMANTICS_UNCERTAIN", mixed_label: str = "VISUAL_INTERPRETATION_UNCERTAIN") -> Column:
    """struct(has_legend, status, label) of colours of struct(r, g, b): red and green mean wrong and right only where a legend says so."""
    low = F.lower(text)
    legend = F.lit(False)
    for w in legend_words:
        legend = legend | F.contains(low, F.lit(w.lower()))
    red = F.exists(colours, lambda c: (c["r"] > 150) & (c["g"] < 100) & (c["b"] < 100))
    green = F.exists(colours, lambda c: (c["g"] > 130) & (c["r"] < 120) & (c["b"] < 120))
    status = F.when(~legend & (F.size(colours) > 0), "uncertain").when(legend & red & green, "uncertain").when(legend & green, "correct").when(legend & red, "incorrect").otherwise("neutral")
    label = F.when(~legend & (F.size(colours) > 0), missing_label).when(legend & red & green, mixed_label)
    return F.struct(legend.alias("has_legend"), status.alias("status"), label.alias("label"))


def training_record(source: Column, correct: Column, incorrect: Column, marker: Column, colour: Column, confidence: Column) -> Column:
    """struct of a training pair: a wrong translation is never the target; verified at high confidence only; empty values are null."""
    full = lambda c: F.when(c != "", c)
    sure = F.coalesce(confidence, F.lit("low"))
    evidence = F.struct(F.coalesce(full(marker), F.lit("none")).alias("marker"), F.coalesce(full(colour), F.lit("uncertain")).alias("color"), sure.alias("confidence"))
    return F.struct(source.alias("source"), full(correct).alias("positive_example"), full(incorrect).alias("negative_example"), evidence.alias("evidence"), F.when(sure == "high", "verified").otherwise("uncertain").alias("status"))


def charter_faults(label: Column, is_target: Column, reference: Column, checks: Column) -> Column:
    """array of what an example breaks: 'label', 'target', 'reference' and the names of blocking checks that are not met."""
    faults = F.array(
        F.when(~F.coalesce(label.isin(*ALLOWED_LABELS), F.lit(False)), "label"), F.when(is_target & label.isin(*NEVER_TARGETS), "target"), F.when(F.coalesce(reference, F.lit("")) == "", "reference"),
        *(F.when(~F.coalesce(checks[c], F.lit(False)), c) for c in BLOCKING_CHECKS),
    )
    return F.filter(faults, lambda f: f.isNotNull())


def runs(df: DataFrame, keys: list[str], place: str, gap: int = 1) -> DataFrame:
    """(keys, ``first``, ``last``) of the runs of places, those less than ``gap`` + 1 apart joined. One shuffle on the keys."""
    w = Window.partitionBy(*keys).orderBy(place)
    new = F.coalesce((F.col(place) - F.lag(place).over(w) > gap).cast("int"), F.lit(1))
    return df.select(*keys, place, new.alias("_new")).withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min(place).alias("first"), F.max(place).alias("last")).drop("_run")


def content_blocks(pixels: DataFrame, image: str, share: float = 0.01, height: int = 10) -> DataFrame:
    """(``image``, ``y1``, ``y2``) of the runs of rows with ink in more than ``share`` of the columns.

    ``pixels`` has the image, y, x and value. A run must be higher than
    ``height`` rows, but for one that reaches the last row.
    """
    rows = pixels.groupBy(image, "y").agg(F.avg((F.col("value") < 128).cast("int")).alias("ink"))
    size = rows.groupBy(image).agg((F.max("y") + 1).alias("h"))
    out = runs(rows.where(F.col("ink") > share), [image], "y").join(size, image)
    return out.where((F.col("last") + 1 - F.col("first") > height) | (F.col("last") + 1 == F.col("h"))).select(image, F.col("first").alias("y1"), (F.col("last") + 1).alias("y2"))


def word_boxes(pixels: DataFrame, image: str, fill: float = 0.02, gap: int = 8, width: int = 15, height: int = 10) -> DataFrame:
    """(``image``, x_min, y_min, x_max, y_max, confidence) of words by the ink of their columns.

    ``pixels`` has the image, y, x and value. Columns of more dark pixels than
    max(1, fill * height) belong to a word; ``gap`` others end it, before its
    last column then, and a word that none ends reaches the border.
    """
    size = pixels.groupBy(image).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    dark = pixels.where("value < 128").select(image, "y", "x")
    columns = dark.groupBy(image, "x").agg(F.count("*").alias("n")).join(size, image).where(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("_h") * fill)))
    words = runs(columns.select(image, "x"), [image], "x", gap).join(size, image)
    ended = F.col("_w") - 1 - F.col("last") >= gap
    words = words.withColumn("x_max", F.when(ended, F.col("last")).otherwise(F.col("_w"))).withColumn("x_min", F.col("first")).where(F.col("x_max") - F.col("x_min") >= F.greatest(F.lit(1), F.lit(width)))
    inside = dark.alias("d").join(words.alias("w"), (F.col(f"d.{image}") == F.col(f"w.{image}")) & (F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")))
    boxes = inside.groupBy(F.col(f"w.{image}").alias(image), "x_min", "x_max").agg(F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_max")).where(F.col("y_max") - F.col("y_min") >= height)
    return boxes.select(image, "x_min", "y_min", "x_max", "y_max", F.lit(0.7).alias("confidence"))


def document_fingerprints(regions: DataFrame, document: str, head: list[str], body: list[str], order: str) -> DataFrame:
    """(``document``, ``fingerprint``): SHA-256 of the whole document as JSON with sorted keys and without blanks.

    ``head`` columns belong to the document, ``body`` ones to its regions, which
    stand in ``order``; nulls are written as null. A document's regions are
    those of a few pages.
    """
    region = F.struct(*(F.col(c) for c in sorted(body)))
    one = regions.groupBy(document, *head).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), region.alias("r")))).alias("_r"))
    fields = {document: F.col(document), **{h: F.col(h) for h in head}, "regions": F.col("_r.r")}
    text = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return one.select(document, F.sha2(text, 256).alias("fingerprint"))


def lifecycle_faults(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_id, ``fault``) of lifecycle records that don't fit their document.

    Records have record_id, document_id, source_id, fingerprint and
    superseded_by, documents document_id, source_id and fingerprint. Faults, the
    first that holds: 'document' (there is none), 'source', 'fingerprint' (the
    document changed since), 'superseded' (another record took its place).
    """
    d = documents.select("document_id", F.col("source_id").alias("_source"), F.col("fingerprint").alias("_print"), F.lit(True).alias("_there"))
    both = records.join(d, "document_id", "left")
    fault = F.when(F.col("_there").isNull(), "document").when(~F.col("source_id").eqNullSafe(F.col("_source")), "source").when(~F.col("fingerprint").eqNullSafe(F.col("_print")), "fingerprint")
    return both.select("record_id", fault.when(F.col("superseded_by").isNotNull(), "superseded").alias("fault")).where("fault is not null")
