"""Mixing of sources to target shares of a total size, with a cap on repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.tokens import count_tokens
from scanloom.session import materialise

#: Hash buckets of a source's permutation; the one bucket cut by the budget is ordered row by row.
BUCKETS = 4096
#: The most target rows that are gathered on the driver.
MAX_TARGETS = 100_000


@dataclass(frozen=True)
class Plan:
    """What to take of one source: every document ``passes`` times and ``rest`` tokens once more."""

    source: str
    weight: float
    share: float
    tokens: int
    max_repeats: int
    passes: int
    rest: int


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def _tilted(tokens: list[int], goal: list[float], exponent: float) -> list[float]:
    """Token shares pulled towards ``goal``: proportional to share^(1-exponent) * goal^exponent."""
    total = sum(tokens)
    raw = [(n / total) ** (1 - exponent) * g**exponent if n and g else 0.0 for n, g in zip(tokens, goal)]
    return [x / sum(raw) for x in raw]


def bisect_exponent(allowed, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest exponent in [low, high] for which ``allowed`` holds, if it holds up to a point."""
    if allowed(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if allowed(middle) else (low, middle)
    return low


def temperature_shares(tokens: list[int], target_entropy: float, repeats: list[int], total: int) -> tuple[float, list[float]]:
    """(exponent, shares): token shares raised to an exponent in [0, 1] and normalised.

    The exponent is bisected to the point where the entropy of the shares
    reaches ``target_entropy``, or before it where a source would be repeated
    more than allowed within ``total`` tokens. 1 is the natural mix, 0 an even one.
    """
    even = [1.0 if n else 0.0 for n in tokens]
    even = [x / sum(even) for x in even]

    def allowed(pull: float) -> bool:
        shares = _tilted(tokens, even, pull)
        return entropy(shares) <= target_entropy and all(s * total <= r * n + 1e-6 for s, r, n in zip(shares, repeats, tokens))

    pull = bisect_exponent(allowed)
    return 1 - pull, _tilted(tokens, even, pull)


def plan_mix(rows: list[tuple[str, float, int, int]], total_tokens: int | None = None) -> list[Plan]:
    """Budgets for (source, weight, max_repeats, tokens) rows.

    Weights are normalised over the sources that have tokens. Shares are the
    natural ones pulled towards the weights, at the largest exponent, found by
    bisection, that keeps the repetition caps; at 1 the weights are met. Without
    ``total_tokens`` the total is the largest at which they are; a total beyond
    all repetitions is cut to what there is.
    """
    usable = _usable(rows)
    if not usable:
        return _budgets(rows, [], [], 0)
    norm = sum(r[1] for r in usable)
    goal = [r[1] / norm for r in usable]
    tokens, repeats = [r[3] for r in usable], [r[2] for r in usable]
    total = min(r * n / g for r, n, g in zip(repeats, tokens, goal)) if total_tokens is None else min(total_tokens, sum(r * n for r, n in zip(repeats, tokens)))

    def fits(shares: list[float]) -> bool:
        return all(s * total <= r * n * (1 + 1e-12) for s, r, n in zip(shares, repeats, tokens))

    shares = _tilted(tokens, goal, bisect_exponent(lambda e: fits(_tilted(tokens, goal, e))))
    if not fits(shares):  # even the natural shares exceed a cap: fill the capped sources, spread the rest
        budget, open_, left = {}, set(range(len(usable))), float(total)
        while open_:
            w = sum(goal[k] for k in open_)
            full = [k for k in open_ if goal[k] / w * left >= repeats[k] * tokens[k]]
            for k in full or list(open_):
                budget[k] = min(repeats[k] * tokens[k], goal[k] / w * left)
            open_ -= set(full or open_)
            left = total - sum(budget.values())
        shares = [budget[k] / total for k in range(len(usable))]
    return _budgets(rows, usable, shares, total)


def plan_temperature(rows: list[tuple[str, float, int, int]], target_entropy: float | None = None, total_tokens: int | None = None) -> list[Plan]:
    """Budgets by temperature: token shares raised to the exponent at which they reach ``target_entropy`` or a repetition limit.

    The entropy aimed at is that of the weights by default, the total the
    tokens there are. Weights say how even the mix is to be, not which source
    gets how much.
    """
    usable = _usable(rows)
    if not usable:
        return _budgets(rows, [], [], 0)
    norm = sum(r[1] for r in usable)
    tokens, repeats = [r[3] for r in usable], [r[2] for r in usable]
    total = sum(tokens) if total_tokens is None else min(total_tokens, sum(r * n for r, n in zip(repeats, tokens)))
    aim = entropy([r[1] / norm for r in usable]) if target_entropy is None else target_entropy
    _, shares = temperature_shares(tokens, aim, repeats, total)
    return _budgets(rows, usable, shares, total)


def _usable(rows: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    return [r for r in rows if r[1] and r[1] > 0 and r[2] and r[2] > 0 and r[3]]


def _budgets(rows: list[tuple[str, float, int, int]], usable: list[tuple[str, float, int, int]], shares: list[float], total: float) -> list[Plan]:
    found = {}
    for (source, weight, cap, n), share in zip(usable, shares):
        budget = min(int(share * total + 0.5), cap * n)
        found[source] = Plan(source, weight, share, n, cap, budget // n, budget % n)
    return [found.get(s) or Plan(s, w or 0.0, 0.0, n or 0, r or 0, 0, 0) for s, w, r, n in rows]


def _sized(docs: DataFrame, key: str, source: str, text: str, path: str | None) -> DataFrame:
    sized = count_tokens(docs.select(F.col(key), F.col(source), F.col(text)), text, path).select(key, source, "n_tokens")
    return sized.where("n_tokens > 0")


def source_budgets(sized: DataFrame, targets: DataFrame, source: str, total_tokens: int | None, by_temperature: bool = False) -> list[Plan]:
    """The plan of each target; gathers one row per target, of which there may be ``MAX_TARGETS``."""
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("cap"))
    have = sized.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    rows = goal.join(have, "source", "left").orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    have_all = [(r["source"], r["weight"], r["cap"], r["tokens"] or 0) for r in rows]
    return plan_temperature(have_all, None, total_tokens) if by_temperature else plan_mix(have_all, total_tokens)


def mix_sources(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    total_tokens: int | None = None, seed: int = 0, path: str | None = None, by_temperature: bool = False,
) -> DataFrame:
    """One row per use of a document in the mix: (``key``, ``source``, ``copy`` from 1, ``n_tokens``, ``place``).

    ``targets`` has source, weight and max_repeats; sizes are in tokens of the
    vocabulary at ``path``. Shares are those of ``plan_mix`` or, ``by_temperature``,
    of ``plan_temperature``. Documents of null or other sources, and those
    without tokens, are left out, as are null or non-positive weights. Copies
    are whole passes over a source and, last, a part of one pass: the head of a
    permutation by hash, up to the budget. ``place`` orders each pass at random.
    Repeated keys are different documents. Each text is read once; what is
    shuffled are (key, source, size) rows of the last pass.
    """
    sized = materialise(_sized(docs, key, source, text, path))
    plans = [p for p in source_budgets(sized, targets, source, total_tokens, by_temperature) if p.passes or p.rest]
    schema = "source string, passes int, rest bigint"
    plan = docs.sparkSession.createDataFrame([(p.source, p.passes, p.rest) for p in plans], schema).withColumnRenamed("source", "_s")
    rows = sized.withColumnRenamed(source, "_src").join(F.broadcast(plan), F.col("_src") == F.col("_s")).drop("_s")  # at most MAX_TARGETS rows
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("_b", F.pmod(F.col("_h"), F.lit(BUCKETS)))

    bucket = rows.where("rest > 0").groupBy("_src", "_b").agg(F.sum("n_tokens").alias("_t"), F.max("rest").alias("_rest"))
    upto = F.sum("_t").over(Window.partitionBy("_src").orderBy("_b"))  # at most BUCKETS rows a source
    bucket = bucket.withColumn("_end", upto).where("_end - _t < _rest").select("_src", "_b", (F.col("_end") - F.col("_t")).alias("_begin"), (F.col("_end") > F.col("_rest")).alias("_cut"))
    head = rows.join(bucket, ["_src", "_b"])
    cut = head.where("_cut").withColumn("_sum", F.sum("n_tokens").over(Window.partitionBy("_src").orderBy("_h", key)) + F.col("_begin"))
    # The document that crosses the budget is taken if that comes nearer to it.
    cut = cut.where("_sum - rest <= n_tokens / 2.0")
    last = head.where("not _cut").select(key, "_src", "n_tokens", "passes").unionByName(cut.select(key, "_src", "n_tokens", "passes"))
    whole = rows.where("passes > 0").select(key, "_src", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy"))
    used = whole.unionByName(last.select(key, "_src", "n_tokens", (F.col("passes") + 1).alias("copy")))
    return used.select(key, F.col("_src").alias("source"), "copy", "n_tokens", F.xxhash64(F.lit(seed), "copy", F.col(key).cast("string")).alias("place"))


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, uses, most_copies, tokens, share, gap) of every target.

    A target without documents has 0 uses and a share of 0; ``gap`` is share less weight.
    """
    got = mix.groupBy("source").agg(F.count("*").alias("uses"), F.max("copy").alias("most_copies"), F.sum("n_tokens").alias("tokens"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a target
    out = targets.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).join(got, "source", "left").withColumn("_total", total)
    share = F.coalesce(F.col("tokens") / F.nullif(F.col("_total"), F.lit(0)), F.lit(0.0))
    return out.select(
        "source", "weight", "max_repeats", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), share.alias("share"), (share - F.col("weight")).alias("gap"),
    )
