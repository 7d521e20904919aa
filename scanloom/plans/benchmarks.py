"""Queries for benchmark aggregates. Recognised regions serve as result rows: engine, kind as variant, confidence as metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import benchmarks as B
from scanloom.plans import sql
from scanloom.session import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region_records").select("region_no", "engine", F.col("kind").alias("variant"), F.element_at("meta", "lang").alias("lang"), "page_number", "confidence", "error")


COALESCED = "coalesce(text, '')"
ROWS = "(SELECT region_no, engine, kind AS variant, meta['lang'] AS lang, page_number, confidence, error FROM region_records)"


def golden_pivot(spark, sf_dir):
    sets = (("engine", "variant"), ("engine", "variant", "lang"), ("engine",))
    return B.pivot(_rows(spark, sf_dir), sets, ["confidence"], F.col("error").isNotNull())


def best_variant(spark, sf_dir):
    return B.best_variant(_rows(spark, sf_dir), ["engine", "lang"], "variant", "confidence", F.col("error").isNotNull())


def suite_summary(spark, sf_dir):
    out = B.suite_summary(_rows(spark, sf_dir), ["engine"], ["confidence", "page_number"])
    return out.select("engine", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "least", "most")))


def latency_percentiles(spark, sf_dir):
    out = B.latency_statistics(table(spark, sf_dir, "dedup_results"), ["is_duplicate"], "elapsed_ms")
    return out.select("is_duplicate", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


def _metric(df: DataFrame, engine: str) -> DataFrame:
    one = df.where(F.col("engine") == engine)
    return one.agg(F.avg("confidence").alias("cer"), F.max("confidence").alias("accuracy"), F.avg("page_number").alias("latency")).select(
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("cer", "accuracy", "latency")))).alias("x")
    ).select("x.*")


def engine_compare(spark, sf_dir):
    r = _rows(spark, sf_dir)
    out = B.compare_results(_metric(r, "tesseract"), _metric(r, "paddle"))
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("a", "b", "delta", "delta_pct")), "winner")


def gate_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "dedup_results")
    kind = F.when(F.col("is_duplicate"), "Handwritten").otherwise("printed")
    cer, wer = (1 - F.col("text_similarity_score")) / 4, (1 - F.col("field_similarity_score")) / 3
    return d.select("check_id", B.gate_decision(kind, cer, wer).alias("decision")).groupBy("decision").agg(F.count("*").alias("n"))


def ab_decisions(spark, sf_dir):
    r = _rows(spark, sf_dir).groupBy("variant").agg(F.avg(F.when(F.col("engine") == "tesseract", F.col("confidence"))).alias("cur"), F.avg(F.when(F.col("engine") == "paddle", F.col("confidence"))).alias("cand"))
    x = r.select("variant", B.ab_decision(F.col("cur"), F.col("cand")).alias("d"))
    return x.select("variant", F.col("d.decision").alias("decision"), F.round("d.improvement", 6).alias("improvement"))


LIMITS = [("engine", "tesseract", "confidence", 0.30), ("variant", "table", "confidence", 0.36), ("global", "", "confidence", 0.40)]


def ci_violations(spark, sf_dir):
    limits = spark.createDataFrame(LIMITS, "scope string, key string, metric string, max_value double")
    r = _rows(spark, sf_dir).groupBy("engine", "variant").agg(F.round(F.avg("confidence"), 6).alias("value")).withColumn("metric", F.lit("confidence"))
    return B.violations(B.resolve_thresholds(r, limits, [("engine", "engine"), ("variant", "variant")])).select("engine", "variant", "value", "limit", "severity")


def baseline_regressions(spark, sf_dir):
    r = _rows(spark, sf_dir)
    a = r.where("page_number > 1").groupBy("engine").agg(F.avg("confidence").alias("value")).withColumn("metric", F.lit("confidence"))
    b = r.where("page_number = 1").groupBy("engine").agg(F.avg("confidence").alias("value")).withColumn("metric", F.lit("confidence"))
    out = B.baseline_regressions(a, b, ["engine"], 0.0)
    return out.select("engine", "metric", *(F.round(c, 6).alias(c) for c in ("value", "baseline", "change")), "regressed")


def dataset_stats(spark, sf_dir):
    return B.dataset_statistics(table(spark, sf_dir, "documents"), "text", ["lang", "source", "kind"])


def split_by_strata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "kind")
    order = F.struct((F.col("doc_id") * 2654435761) % 1000003, F.col("doc_id"))
    return B.stratified_split(d, ["lang", "kind"], order, 0.8).select("doc_id", "part")


def unique_values(spark, sf_dir):
    """PRJ-07 and PRJ-01: engines of the well recognised text regions."""
    return _rows(spark, sf_dir).where("variant in ('text', 'table') and confidence >= 0.5").select("engine", "lang").distinct()


QUERIES = {f.__name__: f for f in (golden_pivot, best_variant, suite_summary, latency_percentiles, engine_compare, gate_decisions, ab_decisions, ci_violations, baseline_regressions, dataset_stats, split_by_strata, unique_values)}
_m = "avg(CASE WHEN error IS NULL THEN confidence END)"
_pair = lambda e: f"(SELECT unnest(['cer', 'accuracy', 'latency']) AS metric, unnest([avg(confidence), max(confidence), avg(page_number)]) AS value FROM {ROWS} WHERE engine = '{e}')"
SQL = {
    "golden_pivot": f"SELECT engine, variant, lang, CAST(grouping(engine, variant, lang) AS BIGINT) AS level, count(*) AS n, count(error) AS errors, round({_m}, 6) AS mean_confidence FROM {ROWS} GROUP BY GROUPING SETS ((engine, variant), (engine, variant, lang), (engine))",
    "best_variant": f"WITH m AS (SELECT engine, lang, variant, avg(confidence) AS m FROM {ROWS} WHERE error IS NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY engine, lang ORDER BY m, variant) AS k FROM m) SELECT engine, lang, variant AS best_variant, round(m, 6) AS mean_metric FROM r WHERE k = 1",
    "suite_summary": f"WITH l AS (SELECT engine, 'confidence' AS metric, confidence AS v FROM {ROWS} UNION ALL SELECT engine, 'page_number', CAST(page_number AS DOUBLE) FROM {ROWS}) SELECT engine, metric, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS stdev, round(min(v), 6) AS least, round(max(v), 6) AS most FROM l WHERE v IS NOT NULL GROUP BY engine, metric",
    "latency_percentiles": "SELECT is_duplicate, count(elapsed_ms) AS n, round(avg(elapsed_ms), 6) AS mean, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95, round(quantile_cont(elapsed_ms, 0.99), 6) AS p99 FROM dedup_results GROUP BY is_duplicate",
    "engine_compare": f"WITH a AS {_pair('tesseract')}, b AS {_pair('paddle')} SELECT metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta, round((b.value - a.value) / nullif(a.value, 0) * 100, 6) AS delta_pct, CASE WHEN b.value = a.value THEN 'tie' WHEN (b.value < a.value) = (metric IN ('cer', 'wer', 'latency', 'mean', 'median')) THEN 'b' ELSE 'a' END AS winner FROM a FULL JOIN b USING (metric)",
    "gate_decisions": "SELECT CASE WHEN is_duplicate THEN CASE WHEN (1 - text_similarity_score) / 4 <= 0.12 AND (1 - field_similarity_score) / 3 <= 0.20 THEN 'DEPLOY' ELSE 'RETRAIN' END ELSE CASE WHEN (1 - text_similarity_score) / 4 <= 0.05 AND (1 - field_similarity_score) / 3 <= 0.10 THEN 'DEPLOY' ELSE 'RETRAIN' END END AS decision, count(*) AS n FROM dedup_results GROUP BY 1",
    "ab_decisions": f"WITH r AS (SELECT variant, avg(CASE WHEN engine = 'tesseract' THEN confidence END) AS cur, avg(CASE WHEN engine = 'paddle' THEN confidence END) AS cand FROM {ROWS} GROUP BY variant) SELECT variant, CASE WHEN cur = 0 OR cand <= cur THEN 'DEPLOY' ELSE 'ROLLBACK' END AS decision, round(CASE WHEN cur = 0 THEN 100.0 ELSE (cur - cand) / cur * 100 END, 6) AS improvement FROM r",
    "ci_violations": f"WITH r AS (SELECT engine, variant, round(avg(confidence), 6) AS value FROM {ROWS} GROUP BY ALL), l AS (SELECT *, CASE WHEN engine = 'tesseract' THEN 0.3e0 WHEN variant = 'table' THEN 0.36e0 ELSE 0.4e0 END AS lim FROM r) SELECT engine, variant, value, lim AS \"limit\", CASE WHEN value > 1.5 * lim THEN 'error' ELSE 'warning' END AS severity FROM l WHERE value > lim",
    "baseline_regressions": f"WITH a AS (SELECT engine, avg(confidence) AS v FROM {ROWS} WHERE page_number > 1 GROUP BY engine), b AS (SELECT engine, avg(confidence) AS v FROM {ROWS} WHERE page_number = 1 GROUP BY engine) SELECT engine, 'confidence' AS metric, round(a.v, 6) AS value, round(b.v, 6) AS baseline, round((a.v - b.v) / b.v, 6) AS change, (a.v - b.v) / b.v > 0 AS regressed FROM a JOIN b USING (engine) WHERE b.v > 0",
    "dataset_stats": f"WITH t AS (SELECT lang, source, kind, {sql.strip(COALESCED)} AS t FROM documents), w AS (SELECT lang, source, kind, length(t) AS c, len({sql.words('t')}) AS w FROM t), "
    "u AS (SELECT 'all' AS dim, '' AS value, c, w FROM w UNION ALL SELECT 'lang', lang, c, w FROM w UNION ALL SELECT 'source', source, c, w FROM w UNION ALL SELECT 'kind', kind, c, w FROM w) SELECT dim, value, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(w) AS BIGINT) AS words FROM u GROUP BY dim, value",
    "split_by_strata": "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, kind ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS r, count(*) OVER (PARTITION BY lang, kind) AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r",
    "unique_values": f"SELECT DISTINCT engine, lang FROM {ROWS} WHERE variant IN ('text', 'table') AND confidence >= 0.5",
}
