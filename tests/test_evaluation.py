from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scanloom.functions import extraction as E
from scanloom.functions import metrics as M
from scanloom.functions import normalizers as N
from scanloom.functions import text_rules as R
from scanloom.operators import benchmarks as B
from scanloom.operators import evaluation as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_long_fields_are_captured(spark):
    found = one(spark, "Diagnosis: " + "a\n" * 50_000 + "Doctor: B", E.fields)
    assert len(found["diagnosis"]) > 99_000 and found["doctor_name"] == "B"


def test_words_of_any_number_of_kinds_are_told_apart(spark):
    words = [f"w{i}" for i in range(9_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join([*words[:-2], "x", "w0"]))], "a string, b string")
    assert df.select(M.wer(F.col("a"), F.col("b")).alias("w")).first()["w"]["edits"] == 2


def test_dictionary_entries_of_themselves_give_their_case(spark):
    assert one(spark, "Diabetes and Aspirn", N.corrected_words) == "diabetes and aspirin"


def test_presentation_forms_turn_a_line(spark):
    assert one(spark, "ﺺﻴﺨﺸﺗ", N.repair_direction) == "تشخيص"
    assert one(spark, "تشخيص المريض", N.repair_direction) == "تشخيص المريض"


def test_matching_form_keeps_punctuation_and_digits(spark):
    assert one(spark, "أَحمد، ٥٠٠ إلى مدرسة!", N.for_matching) == "احمد، ٥٠٠ الي مدرسه!"


@pytest.mark.parametrize("text", ["", "\n", "a\n\n", "5\n", "\x0b5\r\n7\r", "h\na\nb\nh\nc\nd\nh\n", "x\n(1) note\n"])
def test_rules_over_lines_agree_with_the_pipeline(spark, text):
    step = one(spark, text, lambda c: R.without_footnotes(R.drop_headers(R.drop_page_numbers(c))))
    config = R.RuleConfig(frozenset({"R06", "R07", "R18"}))
    df = spark.createDataFrame([(text,)], "t string")
    out = R.process_text(df, "t", None, config).first()
    assert out["markdown"].split(R.FOOTNOTE_HEADING)[0] == step
    assert out["pages_dropped"] == one(spark, text, R.page_number_lines)


def test_valid_words_are_counted_in_the_text(spark):
    assert one(spark, "ok two☃ مريض x y, é", R.valid_words) == 4 and one(spark, "ok two☃ مريض x y, é", R.valid_ratio) == pytest.approx(4 / 6)


def test_lower_limits(spark):
    rows = spark.createDataFrame([("a", 0.5, None, 0.8), ("b", 0.7, None, 0.8), ("c", 0.9, 0.5, 0.8), ("d", None, 0.5, 0.8)], "k string, value double, limit double, least double")
    got = {(r["k"], r["bound"], r["severity"]) for r in B.violations(rows, least="least").collect()}
    assert got == {("a", "min", "error"), ("b", "min", "warning"), ("c", "max", "error")}


def test_digits_and_letters(spark):
    assert one(spark, "5OO mg and 1V 7ab", V.digits_and_letters) == "500 mg and IV tab" and one(spark, "20 ml", V.digits_and_letters) == "20 مل"
    assert one(spark, None, V.digits_and_letters) is None


def test_phrases(spark):
    got = one(spark, "Left arm, left ARM", lambda c: V.phrases(c, ["left", "left arm"]))
    assert [(p["phrase"], p["start"], p["end"]) for p in got] == [("Left arm", 0, 8), ("left ARM", 10, 18), ("Left", 0, 4), ("left", 10, 14)]


def test_term_accuracy_against_brute_force(spark):
    terms = ["metformin", "aspirin", "edema"]
    pairs = [(1, "metformn for edema", "metformin for a rash"), (2, "nothing here", "aspirin"), (3, "", None), (4, "aspirin aspirn", "asprin")]
    df = spark.createDataFrame(pairs, "id int, ref string, hyp string")
    got = {r["id"]: (r["expected"], r["correct"]) for r in V.term_accuracy(df, "id", "ref", "hyp", spark.createDataFrame([(t,) for t in terms], "t string"), "t").collect()}

    def brute(ref, hyp):
        like = lambda w, t: w == t or M.ratio(w, t) >= 80
        wanted = {max((t for t in terms if like(w, t)), key=lambda t: M.ratio(w, t), default=None) for w in ref.split()} - {None}
        return len(wanted), sum(any(like(w, t) for w in (hyp or "").split()) for t in wanted)

    assert got == {k: brute(r, h) for k, r, h in pairs}


def test_term_statuses(spark):
    got = one(spark, "The Smal intestine was fine", lambda c: V.term_statuses(c, ["small intestine", "fine", "gallbladder"]))
    assert [(s["status"], s["distance"]) for s in got][:2] == [("approximate", 1), ("exact", 0)] and got[2]["status"] == "missing"


def test_mixed_direction(spark):
    segments = F.array(F.struct(F.lit("مريض").alias("text"), F.lit("rtl").alias("dir")), F.struct(F.lit("dose 5").alias("text"), F.lit("ltr").alias("dir")))
    df = spark.createDataFrame([("مريض dose 5 12.5", "ضيرم dose 5 12,5")], "a string, b string")
    m = df.select(V.mixed_direction(F.col("a"), F.col("b"), segments).alias("m")).first()["m"]
    assert (m["direction_errors"], m["segment_accuracy"], m["numeric_preservation"], m["mixed_word_errors"]) == (1, 0.5, 0.5, 0)


def test_table_structure(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", "2"], ["x", ""]], [["a", "b"], ["2", "1.01"]])], "e array<array<string>>, p array<array<string>>")
    t = df.select(V.table_structure(F.col("e"), F.col("p")).alias("t")).first()["t"]
    assert (t["rows_complete"], t["row_completeness"], t["header_preserved"], t["structure_preserved"]) == (1, 0.5, True, False)


def test_boxes_and_marks(spark):
    df = spark.createDataFrame([([0.5, 1.5, 2.0, 3.0],), ([-1.0, 0.0, 1.0, 1.0],), ([1.0, 2.0],), (None,)], "b array<double>")
    assert [r["x"] and tuple(r["x"]) for r in df.select(V.box_xywh(F.col("b")).alias("x")).collect()] == [(0, 2, 2, 3), None, None, None]
    marks = spark.range(1).select(V.marker_union(F.array(F.lit("a"), F.lit("x")), F.array(F.lit("X"), F.lit("b"), F.lit("a"))).alias("m")).first()["m"]
    assert marks == ["a", "x", "b"]


def test_word_boxes_end_before_their_last_column_but_at_the_border(spark):
    dark = {(y, x) for y in range(12) for x in (*range(2, 20), *range(30, 50))}
    px = [("i", y, x, 0 if (y, x) in dark else 255) for y in range(14) for x in range(50)]
    df = spark.createDataFrame(px, "img string, y int, x int, value int")
    got = sorted((r["x_min"], r["y_min"], r["x_max"], r["y_max"]) for r in V.word_boxes(df, "img").collect())
    assert got == [(2, 0, 19, 12), (30, 0, 50, 12)]
    assert [(r["y1"], r["y2"]) for r in V.content_blocks(df, "img").collect()] == [(0, 12)]


def test_document_fingerprint_is_that_of_sorted_json(spark):
    rows = [("d", "v1", 2, "r2", None, 1.5), ("d", "v1", 1, "r1", "نص \"q\"", 2.0)]
    df = spark.createDataFrame(rows, "document_id string, layout_version string, n int, region_id string, text string, x double")
    got = V.document_fingerprints(df, "document_id", ["layout_version"], ["region_id", "text", "x"], "n").first()["fingerprint"]
    whole = {"document_id": "d", "layout_version": "v1", "regions": [{"region_id": r[3], "text": r[4], "x": r[5]} for r in sorted(rows, key=lambda r: r[2])]}
    assert got == hashlib.sha256(json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_training_records_and_charter(spark):
    df = spark.createDataFrame([("", "bad", "high"), ("good", None, None)], "c string, i string, s string")
    t = [r["t"] for r in df.select(V.training_record(F.lit("x"), F.col("c"), F.col("i"), F.lit(None).cast("string"), F.lit(""), F.col("s")).alias("t")).collect()]
    assert (t[0]["positive_example"], t[0]["status"], t[0]["evidence"]["marker"]) == (None, "verified", "none") and t[1]["status"] == "uncertain"
    ok = F.create_map(*(x for c in V.BLOCKING_CHECKS for x in (F.lit(c), F.lit(True))))
    faults = spark.range(1).select(V.charter_faults(F.lit("uncertain"), F.lit(True), F.lit(""), ok).alias("f")).first()["f"]
    assert faults == ["target", "reference"]


def test_colour_needs_a_legend(spark):
    colours = F.array(F.struct(F.lit(200).alias("r"), F.lit(10).alias("g"), F.lit(10).alias("b")))
    status = lambda t: one(spark, t, lambda c: V.colour_semantics(c, colours, ["Legend"]))["status"]
    assert status("see legend") == "incorrect" and status("none") == "uncertain"
