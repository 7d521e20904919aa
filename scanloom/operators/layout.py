"""Regions of pages: reconciliation of analysis runs, geometric matching, decisions, ink bands, lines, synthesis."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def reconcile(existing: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """(``key``, ``action``): a full outer join of two runs by region.

    Both have ``key``, ``type`` and ``bbox``; existing also ``manual``. New
    regions are ADDED; equal ones UNCHANGED; of the others those edited by hand
    are a CONFLICT, and the rest an UPDATE_PROPOSAL or, where not proposed any
    more, a DELETION_PROPOSAL.
    """
    e = existing.select(key, F.col("type").alias("et"), F.col("bbox").alias("eb"), F.coalesce("manual", F.lit(False)).alias("manual"), F.lit(True).alias("_e"))
    p = proposed.select(key, F.col("type").alias("pt"), F.col("bbox").alias("pb"), F.lit(True).alias("_p"))
    both = e.join(p, key, "full_outer")
    same = F.col("et").eqNullSafe(F.col("pt")) & F.col("eb").eqNullSafe(F.col("pb"))
    action = (
        F.when(F.col("_e").isNull(), "ADDED").when(F.col("_p").isNull(), F.when(F.col("manual"), "CONFLICT").otherwise("DELETION_PROPOSAL"))
        .when(same, "UNCHANGED").when(F.col("manual"), "CONFLICT").otherwise("UPDATE_PROPOSAL")
    )
    return both.select(key, action.alias("action"))


def match_boxes(left: DataFrame, right: DataFrame, page: str, left_id: str, right_id: str, min_ratio: float = 0.5, cell: float = 256.0) -> DataFrame:
    """(page, ids, ``iou``) of the boxes of a page that overlap by at least ``min_ratio`` > 0.

    Boxes are spread over the grid cells that they touch and joined by (page,
    cell), so that a page with very many boxes is no single group; a pair is
    kept in the cell of its intersection's upper left corner only. ``bbox`` is a
    struct of x, y, w, h.
    """
    if min_ratio <= 0:
        raise ValueError("min_ratio must be above 0; all pairs would match")

    def spread(df: DataFrame, i: str, b: str) -> DataFrame:
        x = F.explode(F.sequence(F.floor(F.col("bbox.x") / cell), F.floor((F.col("bbox.x") + F.col("bbox.w")) / cell)))
        y = F.explode(F.sequence(F.floor(F.col(f"{b}.y") / cell), F.floor((F.col(f"{b}.y") + F.col(f"{b}.h")) / cell)))
        return df.where("bbox is not null").select(page, i, F.col("bbox").alias(b), x.alias("_cx")).select("*", y.alias("_cy"))

    both = spread(left, left_id, "_a").join(spread(right, right_id, "_b"), [page, "_cx", "_cy"])
    a, b = F.col("_a"), F.col("_b")
    here = (F.floor(F.greatest(a["x"], b["x"]) / cell) == F.col("_cx")) & (F.floor(F.greatest(a["y"], b["y"]) / cell) == F.col("_cy"))
    return both.where(here).select(page, left_id, right_id, overlap_ratio(a, b).alias("iou")).where(F.col("iou") >= min_ratio)


def match_states(pairs: DataFrame, page: str, hypothesis: str, region: str) -> DataFrame:
    """``pairs`` with ``state``: AMBIGUOUS where either side has several partners, CONFLICT for a region edited by hand that differs, else MATCHED.

    ``pairs`` has iou, manual and type_equal.
    """
    n_h = F.count("*").over(Window.partitionBy(page, hypothesis))
    n_r = F.count("*").over(Window.partitionBy(page, region))
    state = F.when(n_h > 1, "AMBIGUOUS").when(n_r > 1, "AMBIGUOUS").when(F.col("manual") & (~F.col("type_equal") | (F.col("iou") < 1.0)), "CONFLICT").otherwise("MATCHED")
    reason = F.when(n_h > 1, "multiple persistent-region candidates").when(n_r > 1, "competing hypotheses").otherwise("")
    return pairs.withColumn("state", state).withColumn("reason", reason)


def unmatched(side: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a side that no pair holds."""
    return side.join(pairs.select(*keys).distinct(), list(keys), "left_anti")


class DecisionError(ValueError):
    """A decision breaks a rule; nothing is applied."""


def decision_errors(regions: DataFrame, candidates: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """(hypothesis_id, error) of the decisions that may not be applied."""
    c = candidates.select("hypothesis_id", "region_id", F.col("state").alias("_state"))
    r = regions.select(F.col("region_id").alias("_rid"), F.coalesce("manual", F.lit(False)).alias("_manual"))
    n = new.select(F.col("hypothesis_id").alias("_new"))
    d = decisions.join(c, ["hypothesis_id", "region_id"], "left").join(r, F.col("region_id") == F.col("_rid"), "left").join(n, F.col("hypothesis_id") == F.col("_new"), "left")
    accept, create = F.col("action") == "ACCEPT_MATCH", F.col("action") == "CREATE_NEW"
    flags = F.col("update_bbox") | F.col("update_type") | F.col("override_manual") | F.col("resolve")
    error = (
        F.when(~accept & ~create, "unknown action")
        .when(create & F.col("_new").isNull(), "hypothesis is not unmatched")
        .when(create & F.col("_rid").isNotNull(), "region id is taken")
        .when(create & flags, "creation takes no flags")
        .when(accept & F.col("_state").isNull(), "no such candidate")
        .when(accept & F.col("_rid").isNull(), "no such region")
        .when(accept & (F.col("_state") == "AMBIGUOUS") & ~F.col("resolve"), "ambiguous match is not resolved")
        .when(accept & F.col("_manual") & (F.col("update_bbox") | F.col("update_type")) & ~F.col("override_manual"), "manual region is not overridden")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason given")
    )
    return d.select("hypothesis_id", error.alias("error")).where("error is not null")


def apply_decisions(regions: DataFrame, hypotheses: DataFrame, candidates: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """The regions after all decisions, or DecisionError if any of them breaks a rule (then nothing is applied).

    Regions and hypotheses have ids, type and bbox. Accepted matches change what
    their flags name, created regions take type and box of their hypothesis and
    aren't manual, all others stay. Of two decisions for a region the one with
    the higher ``seq`` counts.
    """
    first = decision_errors(regions, candidates, new, decisions).first()
    if first:
        raise DecisionError(f"{first['hypothesis_id']}: {first['error']}")
    h = hypotheses.select("hypothesis_id", F.col("type").alias("_ht"), F.col("bbox").alias("_hb"))
    d = decisions.join(h, "hypothesis_id", "left")
    accepted = d.where("action = 'ACCEPT_MATCH'").groupBy("region_id").agg(F.max_by(F.struct("_ht", "_hb", "update_bbox", "update_type", "override_manual"), "seq").alias("x"))
    changed = regions.join(accepted, "region_id", "left").select(
        "region_id", F.when(F.col("x.update_type"), F.col("x._ht")).otherwise(F.col("type")).alias("type"),
        F.when(F.col("x.update_bbox"), F.col("x._hb")).otherwise(F.col("bbox")).alias("bbox"), (F.coalesce("manual", F.lit(False)) | F.coalesce("x.override_manual", F.lit(False))).alias("manual"),
    )
    created = d.where("action = 'CREATE_NEW'").select("region_id", F.col("_ht").alias("type"), F.col("_hb").alias("bbox"), F.lit(False).alias("manual"))
    return changed.unionByName(created)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields as one JSON object with fields in the order given."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def islands(df: DataFrame, keys: Sequence[str], position: str, gap: int) -> DataFrame:
    """``df`` with ``island``: rows of a key in order of position, a new island where the step is above ``gap``."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_new", (F.col(position) - F.lag(position).over(w) > gap).cast("int")).withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(w)).drop("_new")


def ink_bands(pixels: DataFrame, source: str, threshold: int = 200, min_ink: int = 2, max_row_gap: int = 1, min_height: int = 1) -> DataFrame:
    """Bands of rows with ink: (source, x, y, w, h, ordinal). ``pixels`` has source, x, y, value; ink is at or below ``threshold``."""
    rows = pixels.where(F.col("value") <= threshold).groupBy(source, "y").agg(F.count("*").alias("ink"), F.min("x").alias("x0"), F.max("x").alias("x1")).where(F.col("ink") >= min_ink)
    bands = islands(rows, [source], "y", max_row_gap + 2).groupBy(source, "island").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return bands.where(F.col("h") >= min_height).withColumn("ordinal", F.row_number().over(Window.partitionBy(source).orderBy("y"))).drop("island")


def group_lines(boxes: DataFrame, page: str, rtl: bool = True, overlap: float = 0.5) -> DataFrame:
    """``boxes`` (x_min, y_min, x_max, y_max) of a page with ``line_index`` and ``word_index``.

    In order of (y, x) a box joins the first line that it overlaps by half of
    the smaller height, and the line grows; lines are numbered from the top,
    words from the reading side. The order decides, so a page is one group.
    """

    places = StructType([StructField("line_index", IntegerType()), StructField("word_index", IntegerType())])

    def fold(top: list, left: list, bottom: list) -> list[dict]:
        lines: list[list] = []
        for i in sorted(range(len(top)), key=lambda i: (top[i], left[i])):
            for line in lines:
                height = min(bottom[i] - top[i], line[1] - line[0])
                shared = min(bottom[i], line[1]) - max(top[i], line[0])
                if (shared / height >= overlap) if height > 0 else abs(top[i] - line[0]) < 10:
                    line[0], line[1] = min(line[0], top[i]), max(line[1], bottom[i])
                    line[2].append(i)
                    break
            else:
                lines.append([top[i], bottom[i], [i]])
        out: list[dict] = [{}] * len(top)
        for k, line in enumerate(sorted(lines, key=lambda v: v[0])):
            for j, i in enumerate(sorted(line[2], key=lambda i: -left[i] if rtl else left[i])):
                out[i] = {"line_index": k, "word_index": j}
        return out

    @F.pandas_udf(ArrayType(places))
    def number(top: pd.Series, left: pd.Series, bottom: pd.Series) -> pd.Series:
        return pd.Series([fold(list(a), list(b), list(c)) for a, b, c in zip(top, left, bottom)])

    gathered = boxes.groupBy(page).agg(F.collect_list(F.struct(*boxes.columns)).alias("_b"))
    of = lambda c: F.transform("_b", lambda b: b[c].cast("double"))
    placed = gathered.select("_b", number(of("y_min"), of("x_min"), of("y_max")).alias("_p"))
    each = placed.select(F.explode(F.arrays_zip("_b", "_p")).alias("z"))
    return each.select("z._b.*", "z._p.line_index", "z._p.word_index")


def clip_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int, pad: int = 0) -> Column:
    """The (x, y, w, h) box grown by ``pad`` and cut to an image of the given size."""
    x0, y0 = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    x1, y1 = F.least(F.lit(width), x + w + pad), F.least(F.lit(height), y + h + pad)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def valid_box(b: Column) -> Column:
    """Whether a box is complete, finite, not negative and not empty."""
    parts = [b[c].cast("double") for c in "xywh"]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))
    return b.isNotNull() & ok & (parts[2] > 0) & (parts[3] > 0)


def page_texts(regions: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(keys, ``text``): the non-empty texts of a page joined in order. A page holds few regions, so one row gathers them."""
    some = regions.where(f"trim({text}) != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("t")))), lambda s: s["t"]), separator)
    return some.groupBy(*keys).agg(joined.alias("text"))


def split_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ``page_number`` from 1, ``text``) of the parts between form feeds, blank ones dropped and the rest renumbered."""
    parts = F.filter(F.split(text, "\f"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return df.select(key, F.posexplode(parts).alias("_p", "text")).select(key, (F.col("_p") + 1).alias("page_number"), "text")
