"""Aggregates over benchmark rows: pivots, summaries, comparisons and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of which a lower value is better; any other key counts higher as better.
LOWER_IS_BETTER = ("cer", "wer", "latency", "mean", "median")
#: Error rates a model may have at most to be deployed, by kind of text.
GATES = {"printed": (0.05, 0.10), "handwritten": (0.12, 0.20)}
#: Beyond these multiples of its limit a violation is an error, else a warning.
ERROR_ABOVE, ERROR_BELOW = 1.5, 0.7


def pivot(df: DataFrame, keys: Sequence[Sequence[str]], metrics: Sequence[str], failed: Column, places: int = 6) -> DataFrame:
    """Grouping sets ``keys`` of all key columns: rows, errors and the rounded mean of each metric over rows without error.

    Failed rows are counted, not averaged. One shuffle for all sets. Columns
    that a set leaves out are null, and ``level`` is Spark's grouping id.
    """
    all_keys = list(dict.fromkeys(k for ks in keys for k in ks))
    means = [F.round(F.avg(F.when(~failed, F.col(m))), places).alias(f"mean_{m}") for m in metrics]
    sets = [[F.col(k) for k in ks] for ks in keys]
    grouped = df.groupingSets(sets, *(F.col(k) for k in all_keys))
    return grouped.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.sum(failed.cast("int")).cast("bigint").alias("errors"), *means)


def best_variant(df: DataFrame, keys: Sequence[str], variant: str, metric: str, failed: Column) -> DataFrame:
    """The variant of the smallest mean metric within ``keys``; of equals the first by name."""
    means = df.where(~failed).groupBy(*keys, variant).agg(F.avg(metric).alias("_m"))
    return means.groupBy(*keys).agg(F.min(F.struct("_m", F.col(variant).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias("best_variant"), F.round("b._m", 6).alias("mean_metric"))


def suite_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, mean, median, sample deviation, least and most of each metric; one row for each (keys, metric)."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    long = df.select(*keys, values.alias("x")).select(*keys, "x.metric", "x.value").where("value is not null")
    v = F.col("value")
    return long.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("stdev"), F.min(v).alias("least"), F.max(v).alias("most"))


def latency_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and the exact 50th, 95th and 99th percentile by linear interpolation."""
    p = [F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *p)


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, value) tables side by side: difference, percentage and which is better ('a', 'b', 'tie', null if one is missing)."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    delta = F.col("b") - F.col("a")
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    better = F.when(delta == 0, "tie").when((delta < 0) == lower, "b").when(delta.isNotNull(), "a")
    return both.select("metric", "a", "b", delta.alias("delta"), F.when(F.col("a") != 0, delta / F.col("a") * 100).alias("delta_pct"), better.alias("winner"))


def baseline_regressions(now: DataFrame, baseline: DataFrame, keys: Sequence[str], tolerance: float = 0.10) -> DataFrame:
    """Values more than ``tolerance`` above a positive baseline of the same (keys, metric)."""
    joined = now.join(baseline.where("value > 0").withColumnRenamed("value", "baseline"), [*keys, "metric"])
    change = (F.col("value") - F.col("baseline")) / F.col("baseline")
    return joined.select(*keys, "metric", "value", "baseline", change.alias("change"), (change > tolerance).alias("regressed"))


def resolve_thresholds(rows: DataFrame, limits: DataFrame, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``limit``: the first of the levels (scope in ``limits``, key column of ``rows``) that has one, else the global one.

    ``limits`` has scope, key, metric and max_value; the global scope has the key ''.
    """
    out, found = rows, []
    for k, (scope, column) in enumerate([*levels, ("global", "")]):
        one = limits.where(F.col("scope") == scope).select(F.col("key").alias(f"_k{k}"), F.col("metric").alias(f"_m{k}"), F.col("max_value").alias(f"_v{k}"))
        key = F.col(column) if column else F.lit("")
        out = out.join(one, (key == F.col(f"_k{k}")) & (F.col("metric") == F.col(f"_m{k}")), "left")
        found.append(F.col(f"_v{k}"))
    drop = [f"_{c}{k}" for c in "kmv" for k in range(len(levels) + 1)]
    return out.withColumn("limit", F.coalesce(*found)).drop(*drop)


def violations(rows: DataFrame, value: str = "value", limit: str = "limit", least: str | None = None) -> DataFrame:
    """Rows over their limit, or under their ``least`` value, with ``bound`` ('max' or 'min') and ``severity``.

    'error' beyond 1.5 times the limit or below 0.7 of the least, else
    'warning'. A null limit or least bounds nothing; a row that breaks both
    comes out twice.
    """
    over = rows.where(F.col(value) > F.col(limit)).withColumn("bound", F.lit("max"))
    over = over.withColumn("severity", F.when(F.col(value) > ERROR_ABOVE * F.col(limit), "error").otherwise("warning"))
    if least is None:
        return over.drop("bound")
    under = rows.where(F.col(value) < F.col(least)).withColumn("bound", F.lit("min"))
    return over.unionByName(under.withColumn("severity", F.when(F.col(value) < ERROR_BELOW * F.col(least), "error").otherwise("warning")))


def ci_passed(found: DataFrame, fail_on_warning: bool = False) -> DataFrame:
    """One row: errors, warnings and whether the gate is passed."""
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("int")), F.lit(0)).cast("bigint")
    counts = found.agg(n("error").alias("errors"), n("warning").alias("warnings"))
    return counts.withColumn("passed", (F.col("errors") == 0) & ((F.col("warnings") == 0) | F.lit(not fail_on_warning)))


def gate_decision(kind: Column, cer: Column, wer: Column) -> Column:
    """DEPLOY where both error rates are within the gate of the kind of text, else RETRAIN; all but 'handwritten' is printed."""
    hand = F.lower(kind) == "handwritten"
    ok = F.when(hand, (cer <= GATES["handwritten"][0]) & (wer <= GATES["handwritten"][1])).otherwise((cer <= GATES["printed"][0]) & (wer <= GATES["printed"][1]))
    return F.when(ok, "DEPLOY").otherwise("RETRAIN")


def ab_decision(current: Column, candidate: Column) -> Column:
    """struct(decision, improvement in %): a candidate that is not worse is deployed; without a current rate it is, at 100 %."""
    gain = F.when(current == 0, 100.0).otherwise((current - candidate) / current * 100)
    return F.struct(F.when((current == 0) | (candidate <= current), "DEPLOY").otherwise("ROLLBACK").alias("decision"), gain.alias("improvement"))


def dataset_statistics(df: DataFrame, text: str, dims: Sequence[str]) -> DataFrame:
    """Rows, characters and words of the stripped texts: in all and by each dimension."""
    from scanloom.functions.patterns import strip, words

    t = df.select(*dims, strip(F.coalesce(F.col(text), F.lit(""))).alias("_t")).select(*dims, F.length("_t").alias("_c"), F.size(words(F.col("_t"))).alias("_w"))
    values = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    return t.select("_c", "_w", F.explode(values).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("n"), F.sum("_c").cast("bigint").alias("chars"), F.sum("_w").cast("bigint").alias("words"))


def stratified_split(df: DataFrame, strata: Sequence[str], order: Column, ratio: float) -> DataFrame:
    """``df`` with ``part``: the first floor(n * ratio) rows of a stratum by ``order`` are 'train', the others 'test'.

    ``order`` should be a hash of a key with the seed; equal values are told apart by no other rule. Exact
    within a stratum, by one shuffle on the strata.
    """
    w = Window.partitionBy(*strata)
    return df.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w)).withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_n") * F.lit(ratio)), "train").otherwise("test")).drop("_r", "_n")
