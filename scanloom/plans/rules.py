"""Queries for the text rules over noisy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import text_rules as R
from scanloom.functions.patterns import SPACE, WORD
from scanloom.plans import sql
from scanloom.session import spread, table

# What is put around a text so that every rule has something to do.
HEAD = "Ward sheet\n​First “note” – see ‹a›\n"
TAIL = (
    "\nWard sheet\n• rest  and\t fluids \n(2) small print\n¹ smaller print\ncare of the pa-\ntient ✔ and ⚠ «soon»…\n"
    "أُعطي المريض ١٢٣ إلى آخر المدرسة ﻻ ﻷ\n\n\n\nWard sheet\n# done\nlast words here\n"
)


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text and conf of the documents with a text, with rule-triggering lines around it."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    page = (F.col("doc_id") % 90).cast("string")
    text = F.concat(F.lit(HEAD), F.col("text"), F.lit("\n- "), page, F.lit(" -"), F.lit(TAIL))
    return d.select("doc_id", "lang", text.alias("text"), ((F.col("doc_id") % 10) / 10.0).alias("conf"))


NOISY = (
    f"(SELECT doc_id, lang, {sql.q(HEAD)} || text || {sql.q(chr(10) + '- ')} || CAST(doc_id % 90 AS VARCHAR) || ' -' || {sql.q(TAIL)} AS text, "
    "(doc_id % 10) / 10.0 AS conf FROM documents WHERE text IS NOT NULL)"
)

NL = sql.q("\n")
L = sql.lines("text")


def _filtered(test: str) -> str:
    return f"array_to_string(list_filter({L}, lambda x: {test}), {NL})"


def _chain(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, {sql.q(a)}, {sql.q(b)})"
    return c


T = lambda: F.col("text")
_full = f"list_filter(list_transform({L}, lambda x: {sql.strip('x')}), lambda x: x <> '')"
_drop = "CASE WHEN len(list_filter({a}, lambda x: x = {e})) >= 3 AND length({e}) < 80 THEN list_filter({a}, lambda x: x <> {e}) ELSE {a} END"
_bullet = f"^[{R.BULLETS}][{SPACE}]+"
_s = sql.strip("x")
_n = f"len({sql.words(_s)})"
_shape = (
    f"CASE WHEN regexp_matches({_s}, {sql.q(_bullet)}) THEN '- ' || regexp_replace({_s}, {sql.q(_bullet)}, '') "
    f"WHEN {_n} > 0 AND {_n} <= 12 AND NOT regexp_matches({_s}, {sql.q(R.SENTENCE_END)}) AND NOT starts_with({_s}, '#') AND NOT ends_with({_s}, '-') THEN '## ' || {_s} ELSE x END"
)

SIMPLE = {
    "control_chars_stripped": (lambda: R.strip_control(T()), sql.replace_all("text", f"[{R.CONTROL}]", "")),
    "whitespace_collapsed": (lambda: R.collapse_spaces(T()), sql.strip(sql.replace_all(sql.replace_all("text", "[ \t ]+", " "), "\n{3,}", "\n\n"))),
    "hyphenation_joined": (lambda: R.join_hyphenated(T()), sql.replace_all("text", rf"([{WORD}])-[{SPACE}]*\n[{SPACE}]*([{WORD}])", r"\1\2")),
    "page_number_lines_dropped": (lambda: R.drop_page_numbers(T()), _filtered(f"NOT regexp_matches(x, {sql.q(R.PAGE_NUMBER)})")),
    "diacritics_stripped": (lambda: R.strip_diacritics(T()), sql.replace_all("text", f"[{R.DIACRITICS}]", "")),
    "alef_unified": (lambda: R.unify_alef(T(), True), "translate(text, 'أإآىة', 'ااا" + "يه')"),
    "digits_unified": (lambda: R.unify_digits(T()), f"translate(text, '{R.ARABIC_DIGITS}', '0123456789')"),
    "punctuation_unified": (lambda: R.unify_punctuation(T()), f"replace(translate(text, {sql.q(R.PUNCTUATION_FROM)}, {sql.q(R.PUNCTUATION_TO)}), '…', '...')"),
    "quotes_unified": (lambda: R.unify_quotes(T()), f"translate(text, {sql.q(R.QUOTES_FROM)}, {sql.q(R.QUOTES_TO)})"),
    "lam_alef_substituted": (lambda: R.substitute_ligatures(T()), _chain("text", R.LAM_ALEF)),
    "markers_isolated": (lambda: R.isolate_markers(T()), _chain("text", {m: f"[{m}]" for m in R.MARKERS})),
    "markdown_structure": (lambda: R.markdown_structure(T()), f"array_to_string(list_transform({L}, lambda x: {_shape}), {NL})"),
    "footnotes_extracted": (lambda: R.footnotes(T()), f"array_to_string(list_transform(list_filter({L}, lambda x: regexp_matches(x, {sql.q(R.FOOTNOTE)})), lambda x: {_s}), {NL})"),
    "headers_footers_dropped": (
        lambda: R.drop_headers(T()),
        f"CASE WHEN len({_full}) < 6 THEN text ELSE array_to_string("
        + _drop.format(a="(" + _drop.format(a=_full, e=f"({_full})[1]") + ")", e=f"({_full})[-1]")
        + f", {NL}) END",
    ),
}


def _query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return noisy_documents(spark, sf_dir).select("doc_id", f().alias("out"))

    return run


def clean_quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cleaned texts judged by valid words, by language."""
    d = spread(noisy_documents(spark, sf_dir))
    t = R.collapse_spaces(R.unify_quotes(R.unify_punctuation(R.unify_digits(R.drop_headers(R.drop_page_numbers(R.strip_control(T())))))))
    d = d.select("lang", t.alias("t")).select("lang", R.valid_words(F.col("t")).alias("good"), R.word_count(F.col("t")).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("good").alias("valid_words"), F.sum("n").alias("words"), F.sum((F.col("good") >= R.VALID_RATIO * F.col("n")).cast("int")).alias("correct_docs"))


def _clean_sql() -> str:
    control = sql.replace_all("text", f"[{R.CONTROL}]", "")
    paged = f"array_to_string(list_filter({sql.lines('a')}, lambda x: NOT regexp_matches(x, {sql.q(R.PAGE_NUMBER)})), {NL})"
    full = f"list_filter(list_transform({sql.lines('b')}, lambda x: {sql.strip('x')}), lambda x: x <> '')"
    one = _drop.format(a="f", e="f[1]")
    two = _drop.format(a="g", e="f[-1]")
    tidy = f"translate(replace(translate(translate(h, '{R.ARABIC_DIGITS}', '0123456789'), {sql.q(R.PUNCTUATION_FROM)}, {sql.q(R.PUNCTUATION_TO)}), '…', '...'), {sql.q(R.QUOTES_FROM)}, {sql.q(R.QUOTES_TO)})"
    spaced = sql.strip(sql.replace_all(sql.replace_all(tidy, "[ \t ]+", " "), "\n{3,}", "\n\n"))
    return f"""
WITH a AS (SELECT lang, {control} AS a FROM {NOISY}), b AS (SELECT lang, {paged} AS b FROM a), f AS (SELECT lang, b, {full} AS f FROM b),
g AS (SELECT lang, b, f, {one} AS g FROM f), h AS (SELECT lang, CASE WHEN len(f) < 6 THEN b ELSE array_to_string({two}, {NL}) END AS h FROM g),
t AS (SELECT lang, {sql.words(spaced)} AS w FROM h), c AS (SELECT lang, len(list_filter(w, lambda x: regexp_matches(x, {sql.q(R.VALID_WORD)}))) AS good, len(w) AS n FROM t)
SELECT lang, count(*) AS docs, CAST(sum(good) AS BIGINT) AS valid_words, CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN good >= 0.85 * n THEN 1 ELSE 0 END) AS BIGINT) AS correct_docs FROM c GROUP BY lang"""


def validity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_documents(spark, sf_dir).select("doc_id", R.valid_words(T()).alias("good"), F.round(R.valid_ratio(T()), 6).alias("ratio"), R.classification(T()).alias("classification"))


def uncertain_words_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = noisy_documents(spark, sf_dir)
    return d.select("doc_id", R.uncertain_count(T(), F.col("conf")).cast("bigint").alias("flags"), (F.length(R.flag_uncertain(T(), F.col("conf"))) - F.length("text")).cast("bigint").alias("added"))


def markers_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = noisy_documents(spark, sf_dir)
    return d.select("doc_id", F.array_join(R.markers_found(T()), ",").alias("markers"), R.page_number_lines(T()).alias("pages"), R.footnote_count(T()).alias("notes"))


def process_text_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.process_text(noisy_documents(spark, sf_dir), "text", "conf").drop("text")


def paragraphs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_documents(spark, sf_dir).select("doc_id", R.merge_paragraphs(T()).alias("out"))


def nfkc_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_documents(spark, sf_dir).select("doc_id", R.unify_forms(T()).alias("out"))


_w = sql.words("text")
_good = f"len(list_filter({_w}, lambda x: regexp_matches(x, {sql.q(R.VALID_WORD)})))"
_flag = f"len(list_filter({_w}, lambda x: length(x) >= 2 AND NOT starts_with(x, '[')))"
QUERIES = {"clean_quality_by_lang": clean_quality_by_lang} | {name: _query(f) for name, (f, _) in SIMPLE.items()} | {
    "validity_split": validity_split,
    "uncertain_words_flagged": uncertain_words_flagged,
    "markers_by_doc": markers_by_doc,
    "process_text_full": process_text_full,
    "paragraphs_merged": paragraphs_merged,
    "nfkc_forms": nfkc_forms,
}
SQL = {"clean_quality_by_lang": _clean_sql()} | {name: f"SELECT doc_id, {s} AS out FROM {NOISY}" for name, (_, s) in SIMPLE.items()} | {
    "validity_split": f"SELECT doc_id, {_good} AS good, round(CASE WHEN len({_w}) > 0 THEN {_good} * 1.0 / len({_w}) ELSE 0.0 END, 6) AS ratio, "
    f"CASE WHEN len({_w}) > 0 AND {_good} * 1.0 / len({_w}) >= 0.85 THEN 'correct' ELSE 'wrong' END AS classification FROM {NOISY}",
    "uncertain_words_flagged": f"SELECT doc_id, CASE WHEN conf < 0.8 THEN {_flag} ELSE 0 END AS flags, CASE WHEN conf < 0.8 THEN 4 * {_flag} ELSE 0 END AS added FROM {NOISY}",
    "markers_by_doc": f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(map(sql.q, R.MARKERS))}], lambda m: contains(text, m))), ',') AS markers, "
    f"len(list_filter({L}, lambda x: regexp_matches(x, {sql.q(R.PAGE_NUMBER)}))) AS pages, len(list_filter({L}, lambda x: regexp_matches(x, {sql.q(R.FOOTNOTE)}))) AS notes FROM {NOISY}",
}
