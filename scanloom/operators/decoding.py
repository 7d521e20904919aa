"""Decoding of per-frame class scores: greedy with built-in expressions, prefix beam search in Arrow batches."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scanloom.functions.patterns import let


def probabilities(frames: Column) -> Column:
    """Rows of probabilities: rows that add up to about 1 are kept, others go through a stable softmax."""

    def row(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
        soft = let(F.array_max(r), lambda m: let(F.transform(r, lambda x: F.exp(x - m)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(e, lambda x: x / t))))
        return F.when((F.abs(total - 1) <= 1e-3) & (F.array_min(r) >= 0), r).otherwise(soft)

    return F.transform(frames, row)


def best_path(frames: Column, alphabet: str, blank: int = 0) -> Column:
    """Greedy text: the best class of each frame, of equals the first; repeats collapse, blanks go and end a repeat."""
    best = F.transform(frames, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))
    letters = F.array(*map(F.lit, alphabet))
    return let(best, lambda p: F.array_join(F.transform(F.filter(F.transform(p, lambda k, i: F.struct(k.alias("k"), F.when(i > 0, F.try_element_at(p, i)).alias("before"))), lambda s: (s["k"] != blank) & ~s["k"].eqNullSafe(s["before"])), lambda s: letters[s["k"]]), ""))


def best_path_confidence(frames: Column, blank: int = 0) -> Column:
    """The mean probability of the frames that are no blank; 0 without such frames."""
    best = F.transform(frames, lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).alias("k"), F.array_max(r).alias("p")))
    some = F.filter(best, lambda s: s["k"] != blank)
    return let(some, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, s: t + s["p"].cast("double")) / F.size(a)).otherwise(0.0))


def beam(frames: np.ndarray, alphabet: str, blank: int = 0, width: int = 8, classes: int | None = None) -> tuple[str, float]:
    """Prefix beam search: (text, log probability). Each frame keeps its likeliest classes, if limited, and always the blank."""
    beams = {"": (1.0, 0.0)}
    log = 0.0
    for row in frames:
        use = range(len(row)) if classes is None else sorted({blank, *np.argsort(-row, kind="stable")[:classes].tolist()})
        grown: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for text, (pb, pn) in beams.items():
            for k in use:
                p = float(row[k])
                if k == blank:
                    grown[text][0] += (pb + pn) * p
                elif text and text[-1] == alphabet[k]:
                    grown[text][1] += pn * p
                    grown[text + alphabet[k]][1] += pb * p
                else:
                    grown[text + alphabet[k]][1] += (pb + pn) * p
        top = sorted(grown.items(), key=lambda e: (-sum(e[1]), e[0]))[:width]
        norm = sum(sum(v) for _, v in top) or 1.0
        log += math.log(norm)
        beams = {t: (b / norm, n / norm) for t, (b, n) in top}
    text, (b, n) = min(beams.items(), key=lambda e: (-sum(e[1]), e[0]))
    return text, log + math.log(max(b + n, 1e-300))


def normalised(frames: np.ndarray) -> np.ndarray:
    """``probabilities`` of a matrix."""
    keep = (np.abs(frames.sum(1) - 1) <= 1e-3) & (frames.min(1) >= 0)
    e = np.exp(frames - frames.max(1, keepdims=True))
    return np.where(keep[:, None], frames, e / e.sum(1, keepdims=True))


_BEAM = StructType([StructField("text", StringType()), StructField("log_probability", DoubleType())])


def beam_search(frames: Column, alphabet: str, blank: int = 0, width: int = 8, classes: int | None = None) -> Column:
    """struct(text, log_probability) by prefix beam search over rows of scores or probabilities."""

    @F.pandas_udf(_BEAM)
    def beams(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if f is None else beam(normalised(np.array([list(r) for r in f], float)), alphabet, blank, width, classes) for f in s], columns=["text", "log_probability"])

    return beams(frames)
