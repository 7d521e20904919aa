from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scanloom.functions import extraction as E
from scanloom.functions import metrics as M
from scanloom.functions import normalizers as N
from scanloom.functions import text_rules as R
from scanloom.operators import benchmarks as B
from scanloom.operators import layout as L
from scanloom.operators import records as C
from scanloom.operators.decoding import beam, normalised
from scanloom.operators.images import otsu, perceptual_hash, sauvola
from scanloom.operators.routing import best_results, select_engines
from scanloom.plans import analysis, commands
from scanloom.sources import readers, writers


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in cells.items()))
    return df.select(column.alias("v")).first()["v"]


T = lambda: F.col("t")


@pytest.mark.parametrize(
    "rule, text, expected",
    [
        (R.join_hyphenated, "inter-\nnational talk", "international talk"),
        (R.drop_page_numbers, "نص أول\n42\nنص ثانٍ\n\n- 43 -", "نص أول\nنص ثانٍ\n"),
        (R.merge_paragraphs, "one two three four five six seven\neight nine.\n\n- item\nshort\nline", "one two three four five six seven eight nine.\n\n- item\nshort\nline"),
        (R.markdown_structure, "• point\nA short line\nThis ends.", "- point\n## A short line\nThis ends."),
        (R.footnotes, "body\n¹ note\n (2) other", "¹ note\n(2) other"),
        (R.isolate_markers, "done ✔", "done [✔]"),
        (R.drop_headers, "\n".join(["top", *"abcdefghij", "top", "top"]), "\n".join("abcdefghij")),
        (R.collapse_spaces, " a \t b\n\n\n\nc ", "a b\n\nc"),
        (R.substitute_ligatures, "ﻻ", "لا"),
        (N.basic, "ضغط الدم ١٢٠ على ٨٠", "ضغط الدم 120 علي 80"),
        (N.strong, "اموكسيسيلين", "أموكسيسيلين"),
        (N.cleaned, "a . b 1.5 - c", "a  b 1.5  c"),
    ],
)
def test_rules(spark, rule, text, expected):
    assert value(spark, rule(T()), t=text) == expected
    assert value(spark, rule(T()), t=None) is None


def test_pipeline_counts_and_nulls(spark):
    df = spark.createDataFrame([(1, "تم ✔ ١٢\n7\n(1) note\nword here", 0.5), (2, None, 1.0), (3, "", 0.0)], "id int, t string, conf double")
    rows = {r["id"]: r for r in R.process_text(df, "t", "conf").collect()}
    assert rows[1]["pages_dropped"] == 1 and rows[1]["footnotes_count"] == 1 and rows[1]["markers"] == ["✔"] and rows[1]["had_arabic_digits"]
    assert R.UNCERTAIN in rows[1]["markdown"] and "## الحواشي" in rows[1]["markdown"]
    assert rows[2]["markdown"] is None and rows[3]["classification"] == "wrong"
    off = R.process_text(df, "t", "conf", R.RuleConfig(frozenset({"R01"}))).where("id = 1").first()
    assert off["markdown"] == df.first()["t"] and off["rules_applied"] == ["R01"]


def test_matching_view_is_idempotent_and_protects_doses():
    text, changes = N.view_of("خذ ٥٠٠ ملغ مرتين إلى", True)
    assert "٥٠٠ ملغ" in text and ("unify_alef", 1) in changes and N.view_of(text, True) == (text, [])
    assert N.view_of("خذ ٥٠٠ ملغ", protect=False)[0] == "خذ 500 ملغ"


def test_direction(spark):
    assert value(spark, N.repair_direction(T(), True), t="صيخشت") == "تشخيص"
    assert value(spark, N.reversal_ratio(T()), t="تشخيص المريض") <= 0.2
    assert value(spark, N.reversal_ratio(T()), t="صيخشت ضيرملا") >= 0.3


def test_error_rates(spark):
    assert value(spark, M.cer(F.col("a"), F.col("b"))["cer"], a="abcdef", b="xyz") == 1.0
    assert value(spark, M.cer(F.col("a"), F.col("b"))["edits"], a="", b="abc") == 3
    assert value(spark, M.wer(F.col("a"), F.col("b"))["wer"], a="الطبيب هنا", b="الطبيب هناك") == 0.5
    assert M.edit_counts("kitten", "sitting") == (2, 0, 1) and M.edit_counts("", "ab") == (0, 0, 2) and M.edit_counts("ab", "") == (0, 2, 0)
    assert M.ratio("", "") == 100 and M.ratio("abcd", "abxd") == 75 and M.set_ratio("a b", "b a c") == 100
    assert value(spark, M.guarded(F.col("a"), F.col("b"))["text"], a="7 mg", b="1 mg") == "7 mg"


def test_fields_and_masks(spark):
    text = "Patient Name: Ann Lee\nMRN: AB-12345\nDate: 01/02/2031\nDx: flu\ncold\nRx: one, two؛ three"
    df = spark.createDataFrame([(text, 1), (None, 2)], "t string, _strong int")
    f = E.with_fields(df.select("t"), "t").where("t is not null").first()["fields"]
    assert f["patient_name"] == "Ann Lee" and f["patient_id"] == "AB-12345" and f["diagnosis"] == "flu cold" and f["medications"] == ["one", "two", "three"]
    assert value(spark, E.masked(T()), t="mail a.b@c.org now") == "mail [EMAIL] now"
    assert value(spark, E.cell_match(F.col("a"), F.col("b")), a="10", b="10.4") == "ok" and value(spark, E.cell_match(F.col("a"), F.col("b")), a="10", b="") == "missing"
    assert value(spark, E.context_of(T()), t="this is WRONG but right") == "mixed"


def test_match_boxes_against_brute_force(spark):
    import random

    random.seed(3)
    make = lambda n: [(i % 3, i, (random.uniform(0, 900), random.uniform(0, 900), random.uniform(1, 400), random.uniform(1, 400))) for i in range(n)]
    a, b = make(60), make(60)
    schema = "page int, {} int, bbox struct<x:double,y:double,w:double,h:double>"
    got = {(r["l"], r["r"]) for r in L.match_boxes(spark.createDataFrame(a, schema.format("l")), spark.createDataFrame(b, schema.format("r")), "page", "l", "r", 0.2).collect()}

    def iou(p, q):
        w = max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]))
        h = max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
        return w * h / (p[2] * p[3] + q[2] * q[3] - w * h)

    assert got == {(i, j) for pa, i, x in a for pb, j, y in b if pa == pb and iou(x, y) >= 0.2}


def test_apply_is_all_or_nothing(spark):
    box = (1.0, 1.0, 2.0, 2.0)
    regions = spark.createDataFrame([("r", "t", box, True)], "region_id string, type string, bbox struct<x:double,y:double,w:double,h:double>, manual boolean")
    hyp = spark.createDataFrame([("h", "u", (5.0, 5.0, 2.0, 2.0))], "hypothesis_id string, type string, bbox struct<x:double,y:double,w:double,h:double>")
    cand = spark.createDataFrame([("h", "r", "MATCHED")], "hypothesis_id string, region_id string, state string")
    new = hyp.select("hypothesis_id").limit(0)
    schema = "hypothesis_id string, region_id string, action string, update_bbox boolean, update_type boolean, override_manual boolean, resolve boolean, reason string, seq int"
    one = lambda override: spark.createDataFrame([("h", "r", "ACCEPT_MATCH", True, False, override, False, "why", 1)], schema)
    with pytest.raises(L.DecisionError):
        L.apply_decisions(regions, hyp, cand, new, one(False))
    done = L.apply_decisions(regions, hyp, cand, new, one(True)).first()
    assert done["bbox"]["x"] == 5.0 and done["type"] == "t"


def test_bands_lines_and_pages(spark):
    ink = [(1, 1), (2, 1), (1, 2), (2, 2), (1, 5), (4, 5)]
    px = spark.createDataFrame([("s", x, y, 0) for x, y in ink], "source string, x int, y int, value int")
    got = {(r["x"], r["y"], r["w"], r["h"]) for r in L.ink_bands(px, "source", max_row_gap=0).collect()}
    assert got == {(1, 1, 2, 2), (1, 5, 4, 1)}
    boxes = spark.createDataFrame([(1, x, 50, x + 20, 90) for x in (30, 300, 150)] + [(1, 10, 200, 30, 240)], "page int, x_min int, y_min int, x_max int, y_max int")
    order = [(r["line_index"], r["word_index"], r["x_min"]) for r in L.group_lines(boxes, "page").orderBy("line_index", "word_index").collect()]
    assert order == [(0, 0, 300), (0, 1, 150), (0, 2, 30), (1, 0, 10)]
    pages = L.split_pages(spark.createDataFrame([(1, "a\f \fb")], "k int, t string"), "k", "t")
    assert [(r["page_number"], r["text"]) for r in pages.orderBy("page_number").collect()] == [(1, "a"), (2, "b")]


def test_gates_and_pivots(spark):
    assert value(spark, B.gate_decision(T(), F.lit(0.04), F.lit(0.08)), t="printed") == "DEPLOY"
    assert value(spark, B.ab_decision(F.col("a"), F.col("b"))["decision"], a=0.0, b=1.0) == "DEPLOY"
    rows = spark.createDataFrame([("a", "x", 0.1, None), ("a", "x", 0.3, None), ("a", "y", 0.1, "boom")], "e string, v string, cer double, error string")
    all_ = {(r["e"], r["v"]): r for r in B.pivot(rows, [("e", "v"), ("e",)], ["cer"], F.col("error").isNotNull()).collect()}
    assert all_["a", None]["mean_cer"] == 0.2 and all_["a", None]["errors"] == 1 and all_["a", "y"]["mean_cer"] is None
    assert B.best_variant(rows, ["e"], "v", "cer", F.col("error").isNotNull()).first()["best_variant"] == "x"


def test_records_depend_on_order(spark):
    rows = [(0, 1, "same text here"), (0, 2, "same text hera"), (0, 3, "other thing"), (0, 4, None)]
    out = {r["i"]: r["duplicate_of"] for r in C.greedy_unique(spark.createDataFrame(rows, "b int, i bigint, t string"), "b", "i", "t").collect()}
    assert out == {1: None, 2: 1, 3: None, 4: None}


def test_decoding_images_and_routing(spark):
    import numpy as np

    frames = np.full((5, 3), 0.05)
    for i, k in enumerate([1, 1, 0, 1, 2]):
        frames[i, k] = 0.9
    assert beam(normalised(frames), "_ab")[0] == "aab"
    page = np.full((40, 40), 220)
    page[10:20, 5:30] = 20
    assert 20 <= otsu(page) < 220 and (sauvola(page, 15) == 0).sum() > 0 and -(2**63) <= perceptual_hash(page) < 2**63
    pick = select_engines("balanced", F.lit(0.5), F.lit("ar"), F.lit("paragraph"), F.lit(False), F.lit("generic"), F.lit(False), F.lit(0.6))
    assert value(spark, pick, t="x") == ["Tesseract"]
    res = spark.createDataFrame([(1, "a", "some words", 0.0, None), (1, "b", "few", 0.4, None), (1, "c", None, 0.9, "failed")], "p int, engine string, text string, confidence double, error string")
    assert best_results(res, "p").first()["engine"] == "b"


def test_readers_writers_and_commands(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "1", "reference": "a", "hypothesis": "b"}\n', encoding="utf-8")
    bad.write_text('{"id": "1", "reference": "a"}\n', encoding="utf-8")
    assert readers.text_pairs(spark, str(good)).count() == 1
    with pytest.raises(readers.PairError):
        readers.text_pairs(spark, str(bad))
    fixes = tmp_path / "fixes.jsonl"
    fixes.write_text('{"wrong": "x", "right": "y"}\nnot json\n{"incorrect_ocr_output": "x", "correct_text": "z"}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.correction_dictionary(spark, str(fixes)).collect()] == [("x", "z")]
    assert writers.report([{"cer": 0.2, "name": "a"}]).count("⚠") == 1
    df = spark.createDataFrame([("a  b",)], "t string")
    steps = [{"command": "postprocess.collapse_spaces", "params": {"text": "t"}}, {"command": "export.json", "params": {"path": str(tmp_path / "out")}}]
    out, trace = commands.run_plan(spark, {"name": "n", "steps": steps}, df)
    assert out.first()["t"] == "a b" and all(t["ok"] for t in trace) and spark.read.json(str(tmp_path / "out")).count() == 1
    _, trace = commands.run_plan(spark, {"steps": [{"command": "no"}, {"command": "io.read_text"}]}, df)
    assert len(trace) == 1 and not trace[0]["ok"]
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"steps": steps}), encoding="utf-8")
    assert commands.main(["pipeline", str(plan), "--dry-run"]) == 0 and commands.main(["describe", "no"]) == 1


def test_stream_equals_batch(spark, tmp_path):
    from scanloom.streaming import texts as S

    df = spark.createDataFrame([(1, "a  b", "2031-01-01 00:00:00"), (1, "a  b", "2031-01-01 00:00:00"), (2, "c\n7\nd", "2031-01-01 01:00:00")], "id int, t string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = S.cleaned_stream(S.without_redeliveries(S.text_stream(spark, str(tmp_path / "in"), "id int, t string, at timestamp"), ["id"], "at"), "t")
    query = stream.select("id", "markdown").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["id"], r["markdown"]) for r in spark.table("cleaned").collect()}
    assert got == {(r["id"], r["markdown"]) for r in S.cleaned_stream(df.dropDuplicates(["id"]), "t").collect()}


ONE_SIDED = ("normalize_basic", "normalize_strong", "normalize_v1", "normalize_ci", "text_cleaned", "matching_view_counts", "rtl_reversal_ratio", "rtl_fix", "words_corrected")


def matching_results(spark, tmp_path, rows):
    spark.createDataFrame(rows, "result_id bigint, original_text string, matching_text string").write.parquet(str(tmp_path / "matching_results.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ONE_SIDED)
def test_one_sided_queries_take_every_text(spark, tmp_path, name):
    sf = matching_results(spark, tmp_path, [(1, "ab", "ab"), (2, "the mg", None), (2, "the mg", None), (3, "", None), (4, None, "x")])
    assert sorted(r["result_id"] for r in analysis.QUERIES[name](spark, sf).collect()) == [1, 2, 3]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_count_code_points_of_every_script(spark, tmp_path):
    pairs = [("ضغط الدم ١٢٠", "ضعط الدم ١٢٠٠"), ("café noir", "cafe noir"), ("a😀b", "ab"), ("", "دم"), ("plain", "plane"), ("دم", "")]
    sf = matching_results(spark, tmp_path, [(i, *p) for i, p in enumerate(pairs)])
    got = {r["result_id"]: (r["edits"], r["n"], r["cer"]) for r in analysis.cer_pairs(spark, sf).collect()}
    assert got == {i: (plain_edits(a, b), len(a), round(plain_edits(a, b) / len(a), 6) if a else 1.0) for i, (a, b) in enumerate(pairs)}
    wer = {r["result_id"]: r["wer"] for r in analysis.char_wer_legacy(spark, sf).collect()}
    assert wer == {i: round(plain_edits(a, b) / len(a.split()), 6) if a else 1.0 for i, (a, b) in enumerate(pairs)}


def test_glossary_suggests_terms_of_every_script(spark, tmp_path):
    items, terms = ["أموكسيسلين 500 ملغ", "Amoxicilin", "سيبرو٥٠٠", "naïfex", None], [("أموكسيسيلين", "amoxicillin"), ("سيبرو ", None), (None, "naifex")]
    spark.createDataFrame([(v,) for v in items], "medication string").write.parquet(str(tmp_path / "medication_items.parquet"))
    spark.createDataFrame(terms, "canonical string, latin_name string").write.parquet(str(tmp_path / "medical_terms.parquet"))
    got = {r["word"]: (r["term"], r["distance"]) for r in analysis.glossary_suggestions(spark, str(tmp_path)).collect()}
    assert got == {"أموكسيسلين": ("أموكسيسيلين", 1), "amoxicilin": ("amoxicillin", 1), "سيبرو": ("سيبرو", 0), "naïfex": ("naifex", 1)}


def hash_rows(spark, tmp_path):
    """64 signs each, in runs of slowly changing ones, so that near pairs lie across labels and chains of clusters arise."""
    import random

    random.seed(7)
    rows, signs = [], [random.random() < 0.5 for _ in range(64)]
    for i in range(160):
        if i % 20 == 0:
            signs = [random.random() < 0.5 for _ in range(64)]
        for k in random.sample(range(64), 3):
            signs[k] = not signs[k]
        rows.append((i, [1.0 if s else -1.0 for s in signs], i % 3))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return {i: sum(1 << (63 - k) for k, v in enumerate(e) if v > 0) for i, e, _ in rows}


def test_hash_pairs_against_brute_force(spark, tmp_path, monkeypatch):
    from scanloom.operators import blocks

    h = hash_rows(spark, tmp_path)
    expected = {(a, b, (h[a] ^ h[b]).bit_count()) for a in h for b in h if a < b and (h[a] ^ h[b]).bit_count() <= 5}
    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", (4,))
    got = [tuple(r) for r in analysis.phash_hamming_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and any((a - b) % 3 for a, b, _ in got)


def test_hash_clusters_against_the_fold(spark, tmp_path):
    h = hash_rows(spark, tmp_path)
    heads, expected = [], {}
    for i in sorted(h):
        d, k = min(((h[i] ^ h[j]).bit_count(), j) for j in heads) if heads else (65, 0)
        expected[i] = (k, d) if d <= 8 else (i, 0)
        heads += [i] * (d > 8)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in analysis.greedy_clusters(spark, str(tmp_path)).collect()} == expected
    assert len(heads) < len(h)


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()
