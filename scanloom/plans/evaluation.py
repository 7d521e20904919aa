"""Queries for evaluation, summaries and filters over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import metrics as M
from scanloom.functions import normalizers as N
from scanloom.functions.patterns import word_count
from scanloom.operators import evaluation as V
from scanloom.plans import sql
from scanloom.plans.analysis import PAIRS, TEXTS, _coded, _pairs, _texts
from scanloom.plans.analysis import SQL as ANALYSIS_SQL
from scanloom.session import table


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region_records").select("region_no", "scan_id", "page_number", "kind", "engine", "confidence", "error", "text", "meta", "bbox").dropDuplicates(["region_no"])


R = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_no ORDER BY 1) AS rn FROM region_records) WHERE rn = 1)"


def _rounded(c, places: int):
    """Rounded the same way by both engines where a mean falls on a half."""
    return F.round(c + 1e-9, places)


def engine_averages(spark, sf_dir):
    out = V.engine_averages(_regions(spark, sf_dir).withColumn("lang", F.element_at("meta", "lang")), ["confidence"], "page_number", ["kind", "lang"])
    return out.withColumn("avg_confidence", _rounded(F.col("avg_confidence"), 6)).withColumn("throughput", _rounded(F.col("throughput"), 6))


def golden_subset(spark, sf_dir):
    """The first 50 reports in English by number."""
    return table(spark, sf_dir, "documents").where("lang = 'en' and kind = 'report'").orderBy("doc_id").limit(50).select("doc_id", "source")


def layout_regions(spark, sf_dir):
    out = V.layout_choice(_regions(spark, sf_dir).withColumn("scan_page", F.concat_ws("/", "scan_id", "page_number")), "scan_page", "kind")
    return out.select("region_no", "mode", "kept")


def word_box_filter(spark, sf_dir):
    return _regions(spark, sf_dir).where("confidence >= 0.5 and bbox.w >= 5 and bbox.h >= 5").select("region_no", F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))


def dataset_export(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "kind", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", "kind", F.length("t").alias("ground_truth_length"), word_count(F.col("t")).alias("word_count"))


def document_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "kind")


def boxes_normalised(spark, sf_dir):
    m = table(spark, sf_dir, "medical_regions").select("region_no", "bbox").dropDuplicates(["region_no"])
    box = lambda corners: V.box_xywh(F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h"), corners)
    out = m.select("region_no", box(False).alias("a"), box(True).alias("b"))
    return out.select("region_no", *(F.col(f"a.{c}").alias(c) for c in "xywh"), F.col("b.w").alias("corner_w"), F.col("b.h").alias("corner_h"))


def golden_matrix(spark, sf_dir):
    """Every text with every variant and engine, without a join."""
    lists = {"variant": ("raw", "otsu", "sauvola"), "engine": ("tesseract", "paddle")}
    out = _texts(spark, sf_dir).select("result_id")
    for name, values in lists.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def ci_error_rates(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", V.ci_rates(F.col("ref"), F.col("hyp")).alias("r"))
    return p.select("result_id", F.round("r.cer", 6).alias("cer"), F.round("r.wer", 6).alias("wer"))


def medical_terms_exact(spark, sf_dir):
    names = table(spark, sf_dir, "medical_terms").select(F.explode(F.array(F.lower(F.trim("latin_name")), F.trim("canonical"))).alias("name"))
    return V.term_accuracy(_pairs(spark, sf_dir), "result_id", "ref", "hyp", names, "name").withColumn("accuracy", F.round("accuracy", 6))


def term_status_counts(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", F.explode(V.term_statuses(F.col("hyp"), ["small intestine", "gallbladder", "file"])).alias("x"))
    return p.groupBy("x.term", "x.status").agg(F.count("*").alias("n"))


def mixed_direction_metrics(spark, sf_dir):
    first = lambda p, d: F.struct(F.regexp_extract("ref", p, 0).alias("text"), F.lit(d).alias("dir"))
    segments = F.array(first("[؀-ۿ]+", "rtl"), first("[a-zA-Z]+", "ltr"))
    p = _pairs(spark, sf_dir).select("result_id", V.mixed_direction(F.col("ref"), F.col("hyp"), segments).alias("m")).select("result_id", "m.*")
    return p.select("result_id", *(F.round(c, 6).alias(c) for c in ("cer", "segment_accuracy", "numeric_preservation")), "direction_errors", "mixed_word_errors")


def noise_summary(spark, sf_dir):
    r = _regions(spark, sf_dir).where("confidence is not null").select(F.concat(F.lit("noise_type="), "engine", F.lit(", difficulty="), "page_number").alias("notes"), (1 - F.col("confidence")).alias("cer"))
    return V.noted_summary(r, "notes", "cer", V.PASS_BELOW["noise"])


def harness_aggregate(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(M.cer(F.col("ref"), F.col("hyp"))["cer"].alias("c"), M.wer(F.col("ref"), F.col("hyp"))["wer"].alias("w"))
    return p.agg(F.count("*").alias("pairs"), *(F.round(f(c), 6).alias(n) for c, m in (("c", "cer"), ("w", "wer")) for f, n in ((F.avg, f"mean_{m}"), (F.max, f"max_{m}"))))


def line_confidence(spark, sf_dir):
    """Mean confidence of a scan's lines: all of them, and those with text only; 0 without any."""
    r = _regions(spark, sf_dir).groupBy("scan_id")
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("confidence"))
    return r.agg(_rounded(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("all_lines"), _rounded(F.coalesce(F.avg(text), F.lit(0.0)), 4).alias("text_lines"))


def dedup_counts(spark, sf_dir):
    d = table(spark, sf_dir, "dedup_results")
    return d.agg(F.count("*").alias("checks"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("confidence_score") >= 0.7).alias("passed"), F.round(F.count_if("is_duplicate") / F.count("*"), 6).alias("ratio"))


def dataset_summary(spark, sf_dir):
    r = _regions(spark, sf_dir).groupBy("kind")
    return r.agg(F.count("*").alias("cases"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), *(F.round(f("confidence"), 4).alias(n) for f, n in ((F.avg, "avg_confidence"), (F.min, "min_confidence"), (F.max, "max_confidence"))))


def eval_normalised(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", V.eval_normalised(F.col("ref")).alias("out"))


def full_normalised(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.strong(F.col("ref")).alias("out"))


def matching_normalised(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.for_matching(F.col("ref")).alias("out"))


def digits_and_letters(spark, sf_dir):
    return table(spark, sf_dir, "medication_items").where("medication is not null").select("item_id", V.digits_and_letters(F.col("medication")).alias("out")).distinct()


PHRASES = ("gallbladder region", "oxygen saturation", "left", "region")


def phrase_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", V.phrases(F.col("text"), list(PHRASES)).alias("p"))
    return d.select("doc_id", F.explode("p").alias("p")).groupBy(F.lower("p.phrase").alias("phrase")).agg(F.count("*").alias("n"), F.sum(F.col("p.end") - F.col("p.start")).alias("chars"))


def correction_benchmark(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", "ref", "hyp", N.corrected_words(F.col("hyp"), {"a": "the", "of": "in"}).alias("fixed"))
    return p.select("result_id", F.round(M.cer(F.col("ref"), F.col("hyp"))["cer"], 6).alias("before"), F.round(M.cer(F.col("ref"), F.col("fixed"))["cer"], 6).alias("after"))


def stage_trace(spark, sf_dir):
    return _regions(spark, sf_dir).select("region_no", F.explode("meta").alias("stage", "value"))


def markers_united(spark, sf_dir):
    d = table(spark, sf_dir, "medical_regions").select("region_no", "reading_order").distinct()
    a = F.when(F.col("reading_order") % 2 == 0, F.array(F.lit("✔"), F.lit("★"))).otherwise(F.array(F.lit("⚠")))
    b = F.when(F.col("reading_order") % 3 == 0, F.array(F.lit("X"), F.lit("✗"), F.lit("✔"))).otherwise(F.array(F.lit("x")))
    return d.select("region_no", F.array_join(V.marker_union(a, b), "").alias("marks"))


LEGEND = ("pressure", "reading")


def colour_statuses(spark, sf_dir):
    d = table(spark, sf_dir, "medical_regions").where("text_verbatim is not null").select("region_no", "text_verbatim", F.col("bbox.x").cast("int").alias("x"), F.col("bbox.y").cast("int").alias("y")).dropDuplicates(["region_no"])
    colour = lambda r, g: F.struct((F.col(r) % 256).alias("r"), (F.col(g) % 256).alias("g"), F.lit(50).alias("b"))
    return d.select("region_no", V.colour_semantics(F.col("text_verbatim"), F.array(colour("x", "y"), colour("y", "x")), list(LEGEND)).alias("c")).groupBy("c.has_legend", "c.status", "c.label").agg(F.count("*").alias("n"))


def training_records(spark, sf_dir):
    m = table(spark, sf_dir, "matching_results").select("result_id", "original_text", "matching_text", "facility_id").dropDuplicates(["result_id"])
    sure = F.when(F.col("result_id") % 3 == 0, "high").when(F.col("result_id") % 3 == 1, "medium")
    t = m.select("result_id", V.training_record(F.lit("match"), F.col("matching_text"), F.col("original_text"), F.lit(""), F.col("facility_id"), sure).alias("t"))
    return t.select("result_id", "t.status", F.col("t.evidence.color").alias("color"), F.col("t.evidence.marker").alias("marker"), F.col("t.positive_example").isNull().alias("no_positive"), F.col("t.negative_example").isNull().alias("no_negative"))


def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * 400 + 128))).cast("int").alias("value"))


PX = "(SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 400 + 128))) AS INTEGER) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings))"


def content_blocks(spark, sf_dir):
    return V.content_blocks(_pixels(spark, sf_dir), "vec_id", 0.5, 1)


def word_boxes(spark, sf_dir):
    return V.word_boxes(_pixels(spark, sf_dir), "vec_id", 0.5, 1, 1, 2)


def whole_document_fingerprints(spark, sf_dir):
    m = table(spark, sf_dir, "medical_regions").dropDuplicates(["region_no"])
    box = F.struct(*(F.col(f"bbox.{c}").alias(c) for c in "hwxy"))
    m = m.withColumn("bbox", box)
    return V.document_fingerprints(m, "document_id", ["layout_version"], ["region_id", "region_type", "bbox", "source", "is_manually_edited", "text_verbatim", "normalized_view"], "region_no")


def _lifecycle(spark, sf_dir):
    prints = table(spark, sf_dir, "medical_regions").groupBy("document_id").agg(F.count_distinct("region_no").cast("string").alias("fingerprint"), F.min("source").alias("source_id"))
    n = F.pmod(F.conv(F.substring(F.md5("document_id"), 1, 6), 16, 10).cast("bigint"), F.lit(5))
    records = prints.select(
        F.concat(F.lit("r-"), "document_id").alias("record_id"), F.when(n == 0, F.concat(F.lit("x"), "document_id")).otherwise(F.col("document_id")).alias("document_id"), F.when(n == 1, "other").otherwise(F.col("source_id")).alias("source_id"),
        F.when(n == 2, "0").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(n == 3, "r-next").alias("superseded_by"),
    )
    return records, prints


def lifecycle_audit(spark, sf_dir):
    return V.lifecycle_faults(*_lifecycle(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        engine_averages, golden_subset, layout_regions, word_box_filter, dataset_export, document_lookup, boxes_normalised, golden_matrix, ci_error_rates, medical_terms_exact, term_status_counts, mixed_direction_metrics, noise_summary,
        harness_aggregate, line_confidence, dedup_counts, dataset_summary, eval_normalised, full_normalised, matching_normalised, digits_and_letters, phrase_counts, correction_benchmark, stage_trace, markers_united, colour_statuses,
        training_records, content_blocks, word_boxes, whole_document_fingerprints, lifecycle_audit,
    )
}

_rep = sql.replace_all
_mixed = "regexp_extract_all({c}, '[؀-ۿ]+[a-zA-Z]+|[a-zA-Z]+[؀-ۿ]+')"
_num = r"regexp_extract_all({c}, '\p{{Nd}}+\.?\p{{Nd}}*')"
_off = lambda a, b: f"len(list_filter({_mixed.format(c=a)}, lambda w: NOT list_contains({_mixed.format(c=b)}, w)))"
_cer = lambda e, n, m: f"CASE WHEN {n} > 0 THEN {e} * 1.0 / {n} WHEN {m} > 0 THEN 1.0 ELSE 0.0 END"
_vocab = f"list_distinct(list_concat({sql.words('ref')}, {sql.words('hyp')}))"
_code = lambda c: f"array_to_string(list_transform({sql.words(c)}, lambda w: chr(CAST(33 + list_position(v, w) AS INTEGER))), '')"
_fix = "array_to_string(list_transform(string_split(hyp, ' '), lambda x: CASE lower(x) WHEN 'a' THEN 'the' WHEN 'of' THEN 'in' ELSE x END), ' ')"
_n = "CAST(('0x' || substr(md5(document_id), 1, 6)) AS BIGINT) % 5"
_ci = lambda c: _rep(sql.strip(_rep(f"lower(nfc_normalize({c}))", f"[{sql.SPACE}]+", " ")), f"[^{sql.WORD}{sql.SPACE}؀-ۿݐ-ݿ]", "")
_wd = lambda c: f"regexp_extract_all({c}, '[؀-ۿݐ-ݿa-zA-Z0-9]+')"
_wc = lambda c: f"array_to_string(list_transform({_wd(c)}, lambda w: chr(CAST(33 + list_position(v, w) AS INTEGER))), '')"
SQL = {
    "engine_averages": f"SELECT engine, kind, meta['lang'] AS lang, CAST(grouping(engine, kind, meta['lang']) AS BIGINT) AS level, count(*) AS n, round(avg(confidence) + 1e-9, 6) AS avg_confidence, round(count(*) / nullif(sum(page_number), 0) + 1e-9, 6) AS throughput FROM {R} GROUP BY GROUPING SETS ((engine), (engine, kind), (engine, meta['lang']))",
    "golden_subset": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND kind = 'report' ORDER BY doc_id LIMIT 50",
    "layout_regions": f"WITH w AS (SELECT region_no, kind, coalesce(max(CAST(kind = 'table' AS INT)) OVER p, 0) AS t, coalesce(max(CAST(kind = 'text' AS INT)) OVER p, 0) AS x FROM {R} WINDOW p AS (PARTITION BY scan_id, page_number)) SELECT region_no, CASE WHEN t = 1 AND x = 1 THEN 'COMPLEX' WHEN t = 1 THEN 'TABLES' ELSE 'SIMPLE' END AS mode, NOT (t = 1 AND x = 0) OR coalesce(kind = 'table', false) AS kept FROM w",
    "word_box_filter": f"SELECT region_no, bbox.w AS w, bbox.h AS h FROM {R} WHERE confidence >= 0.5 AND bbox.w >= 5 AND bbox.h >= 5",
    "dataset_export": f"SELECT doc_id, kind, length(coalesce(text, '')) AS ground_truth_length, len({sql.words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS word_count FROM documents",
    "document_lookup": "SELECT doc_id, lang, kind FROM documents WHERE doc_id = 42",
    "boxes_normalised": "WITH b AS (SELECT DISTINCT region_no, bbox.x AS x, bbox.y AS y, bbox.w AS w, bbox.h AS h FROM medical_regions) SELECT region_no, CASE WHEN ok THEN CAST(round_even(x, 0) AS INT) END AS x, CASE WHEN ok THEN CAST(round_even(y, 0) AS INT) END AS y, CASE WHEN ok THEN CAST(round_even(w, 0) AS INT) END AS w, CASE WHEN ok THEN CAST(round_even(h, 0) AS INT) END AS h, CASE WHEN co THEN CAST(round_even(w - x, 0) AS INT) END AS corner_w, CASE WHEN co THEN CAST(round_even(h - y, 0) AS INT) END AS corner_h FROM (SELECT *, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AS ok, x >= 0 AND y >= 0 AND w > x AND h > y AS co FROM b)",
    "golden_matrix": f"SELECT result_id, variant, engine FROM {TEXTS}, (VALUES ('raw'), ('otsu'), ('sauvola')) v(variant), (VALUES ('tesseract'), ('paddle')) e(engine)",
    "ci_error_rates": f"WITH t AS (SELECT result_id, {_ci('ref')} AS a, {_ci('hyp')} AS b FROM {PAIRS}), p AS (SELECT *, list_distinct(list_concat({_wd('a')}, {_wd('b')})) AS v FROM ({_coded('a', 'b', 't')})), q AS (SELECT *, levenshtein({_wc('a')}, {_wc('b')}) AS we, len({_wd('a')}) AS n, len({_wd('b')}) AS m FROM p) SELECT result_id, round({_cer('e', 'length(a)', 'length(b)')}, 6) AS cer, round({_cer('we', 'n', 'm')}, 6) AS wer FROM q",
    "mixed_direction_metrics": f"WITH p AS (SELECT *, replace(ref, ' ', '') AS a, replace(hyp, ' ', '') AS b, regexp_extract(ref, '[؀-ۿ]+') AS s, regexp_extract(ref, '[a-zA-Z]+') AS l FROM {PAIRS}), q AS ({_coded('a', 'b', 'p')}) SELECT result_id, round({_cer('e', 'length(a)', 'length(b)')}, 6) AS cer, (CAST(s <> '' AND contains(hyp, s) AS INT) + CAST(l <> '' AND contains(hyp, l) AS INT)) / 2 AS segment_accuracy, round(CASE WHEN len({_num.format(c='ref')}) > 0 THEN len(list_filter({_num.format(c='ref')}, lambda x: list_contains({_num.format(c='hyp')}, x))) * 1.0 / len({_num.format(c='ref')}) ELSE 1.0 END, 6) AS numeric_preservation, CAST(s <> '' AND NOT contains({_rep('hyp', '[^' + chr(0x600) + '-' + chr(0x6FF) + ']', '')}, s) AS INT) + CAST(l <> '' AND NOT contains({_rep('hyp', '[^a-zA-Z0-9]', '')}, l) AS INT) AS direction_errors, {_off('ref', 'hyp')} + {_off('hyp', 'ref')} AS mixed_word_errors FROM q",
    "noise_summary": f"SELECT engine AS category, count(*) AS cases, round(avg(1 - confidence), 4) AS avg_cer, count(*) FILTER (1 - confidence < 0.2) AS passed, round(count(*) FILTER (1 - confidence < 0.2) / count(*), 2) AS pass_rate FROM {R} WHERE confidence IS NOT NULL GROUP BY 1",
    "harness_aggregate": f"WITH p AS (SELECT *, {_vocab} AS v FROM ({_coded('ref', 'hyp', PAIRS)})), q AS (SELECT {_cer('e', 'length(ref)', 'length(hyp)')} AS c, levenshtein({_code('ref')}, {_code('hyp')}) AS we, len({sql.words('ref')}) AS n, len({sql.words('hyp')}) AS m FROM p), r AS (SELECT c, {_cer('we', 'n', 'm')} AS w FROM q) SELECT count(*) AS pairs, round(avg(c), 6) AS mean_cer, round(max(c), 6) AS max_cer, round(avg(w), 6) AS mean_wer, round(max(w), 6) AS max_wer FROM r",
    "line_confidence": f"SELECT scan_id, round(coalesce(avg(confidence), 0) + 1e-9, 6) AS all_lines, round(coalesce(avg(confidence) FILTER (coalesce(text, '') <> ''), 0) + 1e-9, 4) AS text_lines FROM {R} GROUP BY 1",
    "dedup_counts": "SELECT count(*) AS checks, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (confidence_score >= 0.7) AS passed, round(count(*) FILTER (is_duplicate) / count(*), 6) AS ratio FROM dedup_results",
    "dataset_summary": f"SELECT kind, count(*) AS cases, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, round(avg(confidence), 4) AS avg_confidence, round(min(confidence), 4) AS min_confidence, round(max(confidence), 4) AS max_confidence FROM {R} GROUP BY 1",
    "eval_normalised": f"SELECT result_id, {sql.strip(_rep('translate(' + _rep('ref', '[' + chr(0x64B) + '-' + chr(0x65F) + chr(0x670) + ']', '') + ', ' + sql.q('إأٱى') + ', ' + sql.q('اااي') + ')', f'[{sql.SPACE}]+', ' '))} AS out FROM {TEXTS}",
    "full_normalised": ANALYSIS_SQL["normalize_strong"],
    "matching_normalised": f"SELECT result_id, translate({_rep('ref', '[' + chr(0x64B) + '-' + chr(0x652) + chr(0x670) + ']', '')}, {sql.q('أإآىة')}, {sql.q('ااا' + 'يه')}) AS out FROM {TEXTS}",
    "phrase_counts": "SELECT lower(phrase) AS phrase, count(*) AS n, CAST(sum(length(phrase)) AS BIGINT) AS chars FROM (" + " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(text, '(?i){p}')) AS phrase FROM documents WHERE text IS NOT NULL" for p in PHRASES) + ") GROUP BY 1",
    "correction_benchmark": f"WITH a AS (SELECT result_id, {_cer('e', 'length(ref)', 'length(hyp)')} AS c FROM ({_coded('ref', 'hyp', PAIRS)})), p AS (SELECT result_id, ref, {_fix} AS fixed FROM {PAIRS}), b AS (SELECT result_id, {_cer('e', 'length(ref)', 'length(fixed)')} AS c FROM ({_coded('ref', 'fixed', 'p')})) SELECT a.result_id, round(a.c, 6) AS before, round(b.c, 6) AS after FROM a JOIN b USING (result_id)",
    "stage_trace": f"SELECT region_no, m.key AS stage, m.value AS value FROM (SELECT region_no, unnest(map_entries(meta)) AS m FROM {R})",
    "markers_united": "SELECT region_no, CASE WHEN reading_order % 2 = 0 THEN '✔★' || CASE WHEN reading_order % 3 = 0 THEN '✗' ELSE '' END ELSE '⚠' || CASE WHEN reading_order % 3 = 0 THEN '✗✔' ELSE '' END END AS marks FROM (SELECT DISTINCT region_no, reading_order FROM medical_regions)",
    "colour_statuses": "WITH d AS (SELECT DISTINCT region_no, text_verbatim AS t, CAST(trunc(bbox.x) AS INT) % 256 AS x, CAST(trunc(bbox.y) AS INT) % 256 AS y FROM medical_regions WHERE text_verbatim IS NOT NULL), c AS (SELECT contains(lower(t), 'pressure') OR contains(lower(t), 'reading') AS l, (x > 150 AND y < 100) OR (y > 150 AND x < 100) AS r, (y > 130 AND x < 120) OR (x > 130 AND y < 120) AS g FROM d) SELECT l AS has_legend, CASE WHEN NOT l OR (r AND g) THEN 'uncertain' WHEN g THEN 'correct' WHEN r THEN 'incorrect' ELSE 'neutral' END AS status, CASE WHEN NOT l THEN 'COLOR_SEMANTICS_UNCERTAIN' WHEN r AND g THEN 'VISUAL_INTERPRETATION_UNCERTAIN' END AS label, count(*) AS n FROM c GROUP BY ALL",
    "training_records": "SELECT DISTINCT result_id, CASE WHEN result_id % 3 = 0 THEN 'verified' ELSE 'uncertain' END AS status, coalesce(facility_id, 'uncertain') AS color, 'none' AS marker, coalesce(matching_text, '') = '' AS no_positive, coalesce(original_text, '') = '' AS no_negative FROM matching_results",
    "content_blocks": f"WITH r AS (SELECT vec_id, y FROM {PX} GROUP BY ALL HAVING avg(CAST(value < 128 AS INT)) > 0.5), g AS (SELECT *, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS k FROM r) SELECT vec_id, min(y) AS y1, max(y) + 1 AS y2 FROM g GROUP BY vec_id, k HAVING max(y) + 1 - min(y) > 1 OR max(y) = 7",
    "word_boxes": f"WITH d AS (SELECT vec_id, y, x FROM {PX} WHERE value < 128), c AS (SELECT vec_id, x FROM d GROUP BY ALL HAVING count(*) > 4), g AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS k FROM c), w AS (SELECT vec_id, min(x) AS x_min, CASE WHEN max(x) < 7 THEN max(x) ELSE 8 END AS x_max FROM g GROUP BY vec_id, k) SELECT w.vec_id, x_min, min(y) AS y_min, x_max, max(y) + 1 AS y_max, 0.7 AS confidence FROM w JOIN d ON d.vec_id = w.vec_id AND x >= x_min AND x < x_max GROUP BY w.vec_id, x_min, x_max HAVING max(y) + 1 - min(y) >= 2",
    "lifecycle_audit": f"WITH d AS (SELECT document_id, {_n} AS n FROM medical_regions GROUP BY document_id) SELECT 'r-' || document_id AS record_id, CASE n WHEN 0 THEN 'document' WHEN 1 THEN 'source' WHEN 2 THEN 'fingerprint' ELSE 'superseded' END AS fault FROM d WHERE n < 4",
}
