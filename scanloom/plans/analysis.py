"""Queries for normalisers, metrics, extraction, records, decoding, images and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scanloom.functions import extraction as E
from scanloom.functions import metrics as M
from scanloom.functions import normalizers as N
from scanloom.functions.patterns import SPACE, WORD
from scanloom.operators import decoding as D
from scanloom.operators import images as I
from scanloom.operators import records as C
from scanloom.operators import routing as T
from scanloom.plans import sql
from scanloom.session import table

ALPHABET = "_abc"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, ref, hyp: a text of a matching result and its matching form."""
    m = table(spark, sf_dir, "matching_results").where("original_text is not null and matching_text is not null")
    return m.select("result_id", F.col("original_text").alias("ref"), F.col("matching_text").alias("hyp")).distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, ref: the text of every matching result that has one, with or without a matching form."""
    m = table(spark, sf_dir, "matching_results").where("original_text is not null")
    return m.select("result_id", F.col("original_text").alias("ref")).distinct()


PAIRS = "(SELECT DISTINCT result_id, original_text AS ref, matching_text AS hyp FROM matching_results WHERE original_text IS NOT NULL AND matching_text IS NOT NULL)"
TEXTS = "(SELECT DISTINCT result_id, original_text AS ref FROM matching_results WHERE original_text IS NOT NULL)"


def normalize_basic(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.basic(F.col("ref")).alias("out"))


def normalize_strong(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.strong(F.col("ref")).alias("out"))


def normalize_v1(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.version_1(F.col("ref"), True).alias("out"))


def normalize_ci(spark, sf_dir):
    p = _texts(spark, sf_dir)
    return p.select("result_id", N.for_ci(F.col("ref")).alias("ci"), N.arabic_for_ci(F.col("ref")).alias("arabic"), F.array_join(N.plain_words(F.col("ref")), "|").alias("words"))


def text_cleaned(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.cleaned(F.col("ref")).alias("out"))


def matching_view_counts(spark, sf_dir):
    v = _texts(spark, sf_dir).select("result_id", N.matching_view(F.col("ref"), True).alias("v"))
    return v.select("result_id", "v.text", F.col("v.changes").cast("string").alias("changes"))


def rtl_reversal_ratio(spark, sf_dir):
    p = _texts(spark, sf_dir)
    return p.select("result_id", F.round(N.reversal_ratio(F.col("ref")), 6).alias("as_is"), F.round(N.reversal_ratio(F.reverse("ref")), 6).alias("reversed"))


def rtl_fix(spark, sf_dir):
    return _texts(spark, sf_dir).select("result_id", N.repair_direction(F.reverse("ref")).alias("out"))


def words_corrected(spark, sf_dir):
    p = _texts(spark, sf_dir).select("result_id", N.corrected_words(F.col("ref"), {"patient": "PATIENT", "right": "left"}).alias("out"), N.replaced_substrings(F.col("ref"), [("the ", "a "), ("mg", "milligram")]).alias("r"))
    return p.select("result_id", "out", F.col("r.text").alias("replaced"), F.col("r.hits").alias("hits"))


def cer_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", M.cer(F.col("ref"), F.col("hyp")).alias("c"))
    return p.select("result_id", "c.edits", "c.n", F.round("c.cer", 6).alias("cer"))


def wer_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", M.wer(F.col("ref"), F.col("hyp")).alias("c"))
    return p.select("result_id", "c.edits", "c.n", F.round("c.wer", 6).alias("wer"))


def char_wer_legacy(spark, sf_dir):
    return _pairs(spark, sf_dir).select("result_id", F.round(M.character_wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


def sdi_breakdown(spark, sf_dir):
    return _pairs(spark, sf_dir).select("result_id", M.sdi(F.col("ref"), F.col("hyp")).alias("s")).select("result_id", "s.*")


def indel_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("result_id", F.round(M.indel_ratio(F.col("ref"), F.col("hyp")), 6).alias("ratio"), F.round(M.token_set_ratio(F.col("ref"), F.col("hyp")), 6).alias("set_ratio"))


def term_windows(spark, sf_dir):
    """The nearest run of words to a fixed term in every matching text."""
    return _pairs(spark, sf_dir).select("result_id", M.best_window(F.lit("small intestine"), F.col("hyp")).alias("distance"))


def digit_guardrail(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("result_id", M.guarded(F.col("ref"), F.regexp_replace("hyp", "7", "1")).alias("g"))
    return p.select("result_id", F.col("g.flag").alias("flag"), F.md5("g.text").alias("md5"))


def text_validity(spark, sf_dir):
    r = table(spark, sf_dir, "region_records").where("text is not null").select("region_no", "text").distinct()
    return r.select("region_no", F.round(M.validity(F.col("text")), 6).alias("validity"))


def _labelled(spark, sf_dir):
    f = table(spark, sf_dir, "extracted_fields").select("record_id", "patient_name", "patient_id", "visit_date", "doctor_name", "diagnosis").distinct()
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("-")), F.lit("\n"))
    text = F.concat(line("Patient Name", "patient_name"), line("MRN", "patient_id"), line("Date", "visit_date"), line("Doctor", "doctor_name"), line("Diagnosis", "diagnosis"), F.lit("Rx: one, two؛ three\n"))
    return f.select("record_id", text.alias("text"), *(F.col(c).alias(f"_{c}") for c in ("patient_name", "patient_id", "visit_date", "doctor_name")))


def fields_extracted(spark, sf_dir):
    return E.with_fields(_labelled(spark, sf_dir).select("record_id", "text"), "text").select("record_id", "fields.*").withColumn("medications", F.array_join("medications", "|"))


def patient_fingerprint(spark, sf_dir):
    f = _labelled(spark, sf_dir)
    return f.select("record_id", E.patient_fingerprint(F.col("_patient_name"), F.col("_patient_id"), F.col("_visit_date"), F.col("_doctor_name")).alias("sha"))


def field_confidence(spark, sf_dir):
    f = _labelled(spark, sf_dir)
    return f.select("record_id", E.field_confidence(F.col("_patient_name"), "patient_name").alias("name"), E.field_confidence(F.col("_patient_id"), "patient_id").alias("patient"))


def medication_list(spark, sf_dir):
    f = table(spark, sf_dir, "extracted_fields").where("medications is not null").select("record_id", "medications").distinct()
    return f.select("record_id", F.array_join(E.medication_list(F.col("medications")), "|").alias("items"))


def template_signatures(spark, sf_dir):
    f = _labelled(spark, sf_dir)
    return f.select("record_id", E.template_signature(F.col("text"), F.array("_patient_name", "_doctor_name", "_patient_id")).alias("signature"))


def phi_counts(spark, sf_dir):
    r = table(spark, sf_dir, "region_records").where("text is not null").select("region_no", "text").distinct()
    c = r.select(E.sensitive_counts(F.col("text")).alias("c")).select("c.*")
    return c.agg(*(F.sum(n).cast("bigint").alias(n.lower()) for n in ("EMAIL", "PHONE", "MRN", "DATE")), F.count("*").alias("texts"))


def phi_masked(spark, sf_dir):
    r = table(spark, sf_dir, "region_records").where("text is not null").select("region_no", "text").distinct()
    return r.select("region_no", E.masked(F.col("text")).alias("masked"))


def table_rows_parsed(spark, sf_dir):
    r = table(spark, sf_dir, "region_records").where("kind = 'table' and text is not null").select("region_no", "text").distinct()
    lines = r.select("region_no", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return lines.select("region_no", (F.col("r") + 1).alias("r"), F.posexplode(E.cells(F.col("line"))).alias("c", "cell")).select("region_no", "r", (F.col("c") + 1).alias("c"), "cell")


def table_cells_compared(spark, sf_dir):
    a = table_rows_parsed(spark, sf_dir)
    b = a.where("c != 3").withColumn("cell", F.when(F.col("c") == 2, F.concat(F.lit("1"), F.col("cell"))).otherwise(F.upper("cell"))).withColumnRenamed("cell", "p")
    both = a.join(b, ["region_no", "r", "c"], "left")
    return both.groupBy(E.cell_match(F.col("cell"), F.col("p")).alias("outcome")).agg(F.count("*").alias("n"))


def context_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(E.context_of(F.col("text")).alias("context")).agg(F.count("*").alias("n"))


def weighted_similarity(spark, sf_dir):
    d = table(spark, sf_dir, "extracted_fields").select("record_id", "patient_name", "patient_id").distinct()
    b = d.select((F.col("record_id") - 1).alias("record_id"), F.col("patient_name").alias("name_b"), F.col("patient_id").alias("id_b"))
    return C.field_similarity(d.join(b, "record_id"), {"patient_name": ("patient_name", "name_b"), "patient_id": ("patient_id", "id_b")}).select("record_id", "similarity.*")


def greedy_dedup(spark, sf_dir):
    """Diagnoses deduplicated in order within a facility."""
    d = table(spark, sf_dir, "extracted_fields").where("diagnosis is not null").groupBy("facility_id", "diagnosis").agg(F.min("record_id").alias("record_id"))
    return C.greedy_unique(d.select("facility_id", "record_id", "diagnosis"), "facility_id", "record_id", "diagnosis").select("record_id", "duplicate_of", "kept")


def _hashes(spark, sf_dir):
    """vec_id, label and the signs of all 64 dimensions; the first is the sign bit of the number."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.slice("embedding", 1, 64), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("bigint")))
    return e.select("vec_id", "label", bits.alias("bits"))


def phash_hamming_pairs(spark, sf_dir):
    return C.hamming_pairs(_hashes(spark, sf_dir), "vec_id", "bits", 5).select("vec_id", "other", "d")


def greedy_clusters(spark, sf_dir):
    return C.greedy_clusters_of_all(_hashes(spark, sf_dir), "vec_id", "bits", 8).select("vec_id", "cluster", "distance")


def fuzzy_search_topk(spark, sf_dir):
    d = table(spark, sf_dir, "extracted_fields").where("diagnosis is not null").select("record_id", "diagnosis").distinct()
    return C.search(d, "record_id", F.col("diagnosis"), F.col("diagnosis"), "chronic gastritis and anaemia", 20)


def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = C.nearest_vectors(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


def glossary_suggestions(spark, sf_dir):
    """The nearest Latin or Arabic name of a term for every word of a medication, in whatever script."""
    w = table(spark, sf_dir, "medication_items").where("medication is not null").select(F.explode(F.split("medication", r"[^\p{L}\p{M}]+")).alias("w"))
    t = table(spark, sf_dir, "medical_terms").select(F.explode(F.array(F.trim("latin_name"), F.trim("canonical"))).alias("name")).where("name is not null")
    return C.suggest_terms(w, "w", t, "name")


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, 4), lambda x: x.cast("double"))).alias("m"))


def ctc_greedy(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", D.best_path(F.col("m"), ALPHABET).alias("text"))


def ctc_confident(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", F.round(D.best_path_confidence(D.probabilities(F.col("m"))), 6).alias("confidence"))


def ctc_beam(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", D.beam_search(F.col("m"), ALPHABET).alias("b")).select("vec_id", "b.*")


def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * 400 + 128))).cast("int").alias("value"))


def otsu_threshold(spark, sf_dir):
    return I.otsu_thresholds(_pixels(spark, sf_dir), "vec_id", "value")


def levels_curves(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "i", I.stretched(F.col("value"), 40, 200).alias("value"))


def sauvola(spark, sf_dir):
    m = _pixels(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("a"))
    m = m.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("a", r * 8 + 1, 8), lambda s: s["value"])).alias("m"))
    return m.select("vec_id", I.matrix_kernel(F.col("m"), lambda a: I.sauvola(a, 5)).alias("binary"), I.matrix_kernel(F.col("m"), I.perceptual_hash, LongType()).alias("phash"))


def router_select(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    quality = F.col("doc_id") % 100 / 100.0
    block = F.when(F.col("kind") == "note", "handwriting").when(F.col("kind") == "lab", "table").otherwise("paragraph")
    engines = T.select_engines("high", quality, F.coalesce("lang", F.lit("ar")), block, F.col("doc_id") % 7 == 0, F.col("kind"), F.lit(False), 2.0 + F.col("doc_id") % 9, 3)
    return d.select("doc_id", engines.alias("e")).select("doc_id", F.array_join("e", ",").alias("engines"), T.seconds_per_page(F.col("e")).alias("seconds"))


def ensemble_winner(spark, sf_dir):
    r = table(spark, sf_dir, "region_records").select("scan_id", F.concat_ws("-", "engine", "region_no").alias("engine"), "text", "confidence", "error").distinct()
    return T.best_results(r, "scan_id").select("scan_id", "engine", F.round("composite", 6).alias("composite"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_basic, normalize_strong, normalize_v1, normalize_ci, text_cleaned, matching_view_counts, rtl_reversal_ratio, rtl_fix, words_corrected, cer_pairs, wer_pairs, char_wer_legacy, sdi_breakdown, indel_ratio,
        term_windows, digit_guardrail, text_validity, fields_extracted, patient_fingerprint, field_confidence, medication_list, template_signatures, phi_counts, phi_masked, table_rows_parsed, table_cells_compared,
        context_classes, weighted_similarity, greedy_dedup, phash_hamming_pairs, greedy_clusters, fuzzy_search_topk, vector_topk, glossary_suggestions, ctc_greedy, ctc_confident, ctc_beam, otsu_threshold, levels_curves,
        sauvola, router_select, ensemble_winner,
    )
}

_rep = sql.replace_all
_base = f"{_rep('translate(' + _rep('nfc_normalize(ref)', f'[{N.SIGNS_BASIC}]', '') + chr(44) + sql.q('إأٱآىةـ') + chr(44) + sql.q('اااايه') + ')', f'[{SPACE}]+', ' ')}"
_west = f"translate({_base}, '{N.ARABIC_DIGITS}', '0123456789')"
_dict = "CASE lower(x) " + " ".join(f"WHEN {sql.q(a)} THEN {sql.q(b)}" for a, b in N.MEDICAL_WORDS.items()) + " ELSE x END"
_fold = "translate(translate(ref, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '،؟؛', ',?;')"
# The engine counts edits of bytes, so each character of a pair becomes one byte: its place among the different ones.
_chars = lambda c: f"regexp_extract_all({c}, '(?s).')"
_bytes = lambda c: f"array_to_string(list_transform({_chars(c)}, lambda x: chr(CAST(list_position(cs, x) AS INTEGER))), '')"
_coded = lambda a, b, rows: f"SELECT *, levenshtein({_bytes(a)}, {_bytes(b)}) AS e FROM (SELECT *, list_distinct(list_concat({_chars(a)}, {_chars(b)})) AS cs FROM {rows})"
_vocab = f"list_distinct(list_concat({sql.words('ref')}, {sql.words('hyp')}))"
_code = lambda c: f"array_to_string(list_transform({sql.words(c)}, lambda w: chr(CAST(33 + list_position(v, w) AS INTEGER))), '')"
_hint = lambda w: f"(CASE WHEN starts_with({w}, 'ال') THEN 2 ELSE 0 END + " + " + ".join(f"CAST(contains({w}, {sql.q(h)}) AS INTEGER)" for h in N.REVERSAL_HINTS) + ")"
_ar = lambda c: f"list_filter({sql.words(c)}, lambda w: length(w) >= 3 AND regexp_matches(w, {sql.q(f'^[{N.ARABIC_BLOCKS}]+$')}))"
_rr = lambda c: f"round(CASE WHEN len({_ar(c)}) > 0 THEN len(list_filter({_ar(c)}, lambda w: {_hint('reverse(w)')} > {_hint('w')})) * 1.0 / len({_ar(c)}) ELSE 0.0 END, 6)"
_clean = lambda c: _rep(_rep(c, f"[{SPACE}]+", " "), "^[ \\-:‏‎]+|[ \\-:‏‎]+$", "")
_rec = "(SELECT DISTINCT record_id, patient_name, patient_id, visit_date, doctor_name, diagnosis FROM extracted_fields)"
_cell = "CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) WHEN contains(line, '|') THEN list_filter(string_split(line, '|'), lambda x: trim(x) <> '') ELSE " + sql.words("line") + " END"
_tab = f"t AS (SELECT DISTINCT region_no, text FROM region_records WHERE kind = 'table' AND text IS NOT NULL), l AS (SELECT region_no, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r FROM t), c AS (SELECT region_no, r, unnest({_cell}) AS cell, unnest(range(1, len({_cell}) + 1)) AS c FROM l)"
_bits = lambda part: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[{part}], lambda x: CAST(x > 0 AS BIGINT))), lambda a, b: a * 2 + b)"
_m = "list_transform(range(0, 16), lambda i: embedding[i * 4 + 1 : i * 4 + 4])"
_pbase = "CASE WHEN length(patient_id) < 3 THEN 0.3e0 ELSE least(0.95e0, 0.5e0 + 0.05e0 * length(patient_id)) END"
_pform = r"^[A-Za-z0-9\-/]{3,}$"
_pconf = f"CASE WHEN regexp_matches(patient_id, {sql.q(_pform)}) THEN least(0.95e0, {_pbase} + 0.1e0) ELSE greatest(0.2e0, {_pbase} - 0.2e0) END"
_conf = lambda c, value: f"CASE WHEN {c} IS NULL OR {c} = '' THEN 0e0 ELSE round({value}, 3) END"
_ctx = lambda k: "(" + " OR ".join(f"contains(lower(text), {sql.q(w)})" for w in E.CONTEXT_WORDS[k]) + ")"
_px = "(SELECT vec_id, i, CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 400 + 128))) AS INTEGER) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings))"
_dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_nrm = lambda t: f"sqrt(list_sum(list_transform({t}.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))"
SQL = {
    "normalize_basic": f"SELECT result_id, {sql.strip(_rep(_west, f'[^{WORD}{SPACE}.{chr(92)}-،؛]', ''))} AS out FROM {TEXTS}",
    "normalize_strong": f"SELECT result_id, {sql.strip(_rep('array_to_string(list_transform(string_split(' + sql.strip(_west) + f', {sql.q(chr(32))}), lambda x: {_dict}), {sql.q(chr(32))})', f'[^{WORD}{SPACE}.{chr(92)}-،؛؟:()]', ''))} AS out FROM {TEXTS}",
    "words_corrected": f"SELECT result_id, array_to_string(list_transform(string_split(ref, ' '), lambda x: CASE lower(x) WHEN 'patient' THEN 'PATIENT' WHEN 'right' THEN 'left' ELSE x END), ' ') AS out, replace(replace(ref, 'the ', 'a '), 'mg', 'milligram') AS replaced, CAST(contains(ref, 'the ') AS INTEGER) + CAST(contains(replace(ref, 'the ', 'a '), 'mg') AS INTEGER) AS hits FROM {TEXTS}",
    "rtl_reversal_ratio": f"SELECT result_id, {_rr('ref')} AS as_is, {_rr('reverse(ref)')} AS reversed FROM {TEXTS}",
    "cer_pairs": f"SELECT result_id, e AS edits, length(ref) AS n, round(CASE WHEN length(ref) > 0 THEN e * 1.0 / length(ref) WHEN length(hyp) > 0 THEN 1.0 ELSE 0.0 END, 6) AS cer FROM ({_coded('ref', 'hyp', PAIRS)})",
    "wer_pairs": f"WITH p AS (SELECT *, {_vocab} AS v FROM {PAIRS}), e AS (SELECT result_id, levenshtein({_code('ref')}, {_code('hyp')}) AS edits, len({sql.words('ref')}) AS n FROM p) SELECT result_id, edits, n, round(CASE WHEN n > 0 THEN edits * 1.0 / n WHEN edits > 0 THEN 1.0 ELSE 0.0 END, 6) AS wer FROM e",
    "char_wer_legacy": f"WITH w AS (SELECT result_id, {sql.words('ref')} AS r, {sql.words('hyp')} AS h FROM {PAIRS}), j AS (SELECT *, array_to_string(r, ' ') AS a, array_to_string(h, ' ') AS b FROM w) SELECT result_id, round(CASE WHEN len(r) > 0 THEN e * 1.0 / len(r) WHEN len(h) > 0 THEN 1.0 ELSE 0.0 END, 6) AS wer FROM ({_coded('a', 'b', 'j')})",
    "digit_guardrail": f"WITH p AS (SELECT result_id, ref, replace(hyp, '7', '1') AS h FROM {PAIRS}), d AS (SELECT *, regexp_extract_all(ref, '\\p{{Nd}}+') = regexp_extract_all(h, '\\p{{Nd}}+') AS ok FROM p) SELECT result_id, CASE WHEN NOT ok THEN 'NUMERICAL_DRIFT_DETECTED' END AS flag, md5(CASE WHEN ok THEN h ELSE ref END) AS md5 FROM d",
    "text_validity": f"WITH r AS (SELECT DISTINCT region_no, {sql.strip('text')} AS t FROM region_records WHERE text IS NOT NULL) SELECT region_no, round(CASE WHEN length(t) > 0 THEN length({_rep('t', f'[^{chr(92)}p{{L}}{SPACE}؀-ۿ]', '')}) * 1.0 / length(t) ELSE 0.0 END, 6) AS validity FROM r",
    "patient_fingerprint": f"SELECT record_id, CASE WHEN coalesce(patient_name, '') || coalesce(patient_id, '') || coalesce(visit_date, '') || coalesce(doctor_name, '') = '' THEN '' ELSE sha1(coalesce(patient_name, '') || '|' || coalesce(patient_id, '') || '|' || coalesce(visit_date, '') || '|' || coalesce(doctor_name, '')) END AS sha FROM {_rec}",
    "field_confidence": f"SELECT record_id, {_conf('patient_name', _pbase.replace('patient_id', 'patient_name'))} AS name, {_conf('patient_id', _pconf)} AS patient FROM {_rec}",
    "medication_list": f"WITH f AS (SELECT DISTINCT record_id, medications AS m FROM extracted_fields WHERE medications IS NOT NULL) SELECT record_id, array_to_string(list_filter(list_transform(regexp_split_to_array(m, {sql.q(f'[{SPACE}]*[،,؛;' + chr(10) + f'][{SPACE}]*')}), lambda x: {_clean('x')}), lambda x: x <> ''), '|') AS items FROM f",
    "table_rows_parsed": f"WITH {_tab} SELECT region_no, r, c, {sql.strip('cell')} AS cell FROM c",
    "context_classes": f"SELECT CASE WHEN {_ctx('correct')} AND {_ctx('incorrect')} THEN 'mixed' WHEN {_ctx('correct')} THEN 'correct' WHEN {_ctx('incorrect')} THEN 'incorrect' WHEN {_ctx('revision')} THEN 'revision' END AS context, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "phash_hamming_pairs": f"WITH h AS (SELECT vec_id, {_bits('1:32')} AS x, {_bits('33:64')} AS y FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, bit_count(xor(a.x, b.x)) + bit_count(xor(a.y, b.y)) AS d FROM h a JOIN h b ON a.vec_id < b.vec_id) SELECT * FROM p WHERE d <= 5",
    "vector_topk": f"WITH s AS (SELECT a.vec_id AS query, b.vec_id, round({_dot} / ({_nrm('a')} * {_nrm('b')}), 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query, vec_id, rank, round(s, 5) AS similarity FROM r WHERE rank <= 5",
    "glossary_suggestions": "WITH w AS (SELECT DISTINCT lower(x) AS word FROM (SELECT unnest(regexp_split_to_array(medication, '[^\\p{L}\\p{M}]+')) AS x FROM medication_items) WHERE length(x) >= 3), t AS (SELECT DISTINCT lower(trim(unnest([latin_name, canonical]))) AS term FROM medical_terms), letters AS (SELECT string_agg(DISTINCT c, '' ORDER BY c) AS a FROM (SELECT unnest(regexp_extract_all(word || coalesce(term, ''), '[^a-z]')) AS c FROM w LEFT JOIN t ON true)), d AS (SELECT word, term, levenshtein(translate(word, a, x), translate(term, a, x)) AS d FROM w, t, (SELECT a, array_to_string(list_transform(range(1, length(a) + 1), lambda k: chr(CAST(CASE WHEN k < 97 THEN k ELSE 26 + k END AS INTEGER))), '') AS x FROM letters) WHERE term IS NOT NULL AND abs(length(word) - length(term)) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, term) AS k FROM d WHERE d <= 2) SELECT word, term, d AS distance FROM r WHERE k = 1",
    "ctc_greedy": f"WITH m AS (SELECT vec_id, {_m} AS m FROM embeddings), p AS (SELECT vec_id, list_transform(m, lambda r: list_position(r, list_max(r)) - 1) AS p FROM m) SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 17), lambda i: p[i] <> 0 AND (i = 1 OR p[i] <> p[i - 1])), lambda i: (['_', 'a', 'b', 'c'])[p[i] + 1]), '') AS text FROM p",
    "levels_curves": f"SELECT vec_id, i, CAST(floor(least(255.0, greatest(0.0, (value - 40) * 255.0 / 160)) + 0.5) AS INTEGER) AS value FROM {_px}",
    "otsu_threshold": f"WITH h AS (SELECT vec_id, value AS t, count(*) AS n FROM {_px} GROUP BY ALL), s AS (SELECT vec_id, t, CAST(sum(n) OVER u AS DOUBLE) AS w, CAST(sum(n * t) OVER u AS DOUBLE) AS m, CAST(sum(n) OVER a AS DOUBLE) AS ww, CAST(sum(n * t) OVER a AS DOUBLE) AS mm FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY t), a AS (PARTITION BY vec_id)), v AS (SELECT vec_id, t, coalesce(round(CASE WHEN w < ww THEN power(mm * w / ww - m, 2.0) / (w * (ww - w)) END, 9), -1) AS v FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, t) AS k FROM v) SELECT vec_id, t AS threshold FROM r WHERE k = 1",
}
