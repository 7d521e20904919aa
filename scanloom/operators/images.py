"""Image kernels on matrices of grey values (0 is ink), in NumPy over Arrow batches, and thresholds by aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

_MATRIX = ArrayType(ArrayType(IntegerType()))


def grey(rgb: np.ndarray) -> np.ndarray:
    """BT.601 luma of an (h, w, 3) image in blue, green, red order; a matrix stays."""
    if rgb.ndim == 2:
        return rgb.astype(np.uint8)
    return np.rint(rgb[..., 0] * 0.114 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.299).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The grey value that parts a histogram best, the lowest of equals; values up to it are ink. An even image gives its value."""
    h = np.bincount(values.ravel().astype(np.int64), minlength=256).astype(float)
    if (h > 0).sum() < 2:
        return int(round(float(values.mean()))) if values.size else 0
    w = np.cumsum(h)
    m = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def window_sums(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows with repeated edges, by an integral image."""
    r = size // 2
    p = np.pad(a.astype(float), ((r + 1, r), (r + 1, r)), mode="edge")
    p[0], p[:, 0] = 0, 0
    s = p.cumsum(0).cumsum(1)
    return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]


def sauvola(a: np.ndarray, size: int = 31, k: float = 0.2, spread: float = 128.0) -> np.ndarray:
    """0 for ink and 255 for paper by a threshold of the mean and deviation around each pixel."""
    n = size * size
    mean = window_sums(a, size) / n
    deviation = np.sqrt(np.maximum(window_sums(a.astype(float) ** 2, size) / n - mean**2, 0))
    return np.where(a <= mean * (1 + k * (deviation / spread - 1)), 0, 255).astype(np.uint8)


def crop_content(a: np.ndarray, threshold: int = 240) -> np.ndarray:
    """The part of an image that holds values below ``threshold``; all of it if there are none."""
    ys, xs = np.nonzero(a < threshold)
    return a if not len(ys) else a[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]


def levels(a: np.ndarray, black: int = 0, white: int = 255, gamma: float = 1.0) -> np.ndarray:
    """Values stretched from [black, white] to [0, 255] and bent by gamma."""
    x = np.clip((a.astype(float) - black) / max(1, white - black), 0, 1)
    return np.rint(255 * x ** (1 / gamma)).astype(np.uint8)


def upside_down(a: np.ndarray) -> bool:
    """Whether the lower half of a page holds clearly more ink than the upper."""
    ink = (a < 128).sum(1)
    half = len(ink) // 2
    return bool(ink[half:].sum() > 1.5 * max(1, ink[:half].sum()))


def perceptual_hash(a: np.ndarray) -> int:
    """64 bits: which low frequencies of a 32 x 32 reduction exceed their median; as a signed number."""
    ys = (np.arange(32) * a.shape[0] / 32).astype(int)
    xs = (np.arange(32) * a.shape[1] / 32).astype(int)
    small = a[np.ix_(ys, xs)].astype(float)
    k = np.arange(32)
    dct = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - 2**64 if value >= 2**63 else value


def routed(a: np.ndarray) -> str:
    """'sauvola' for uneven light or faint ink, else 'otsu': light by the spread of bright values of blocks, ink by its contrast."""
    h, w = a.shape
    blocks = [np.percentile(b, 90) for r in np.array_split(a, min(4, h)) for b in np.array_split(r, min(4, w), 1)]
    uneven = (max(blocks) - min(blocks)) / 255
    contrast = (np.percentile(a, 95) - np.percentile(a, 5)) / 255
    return "sauvola" if uneven > 0.12 or contrast < 0.55 else "otsu"


def matrix_kernel(c: Column, kernel, result=_MATRIX) -> Column:
    """``kernel`` of each matrix of a column; matrices stay lists of rows."""

    @F.pandas_udf(result)
    def run(s: pd.Series) -> pd.Series:
        def one(m):
            out = kernel(np.array([list(r) for r in m], np.int64))
            return out.tolist() if isinstance(out, np.ndarray) else out

        return s.map(one, na_action="ignore")

    return run(c)


def otsu_thresholds(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """(image, threshold) from pixel rows by a histogram and running sums: no image is gathered. Values from 0 to 255."""
    h = pixels.groupBy(image, F.col(value).cast("int").alias("t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(image).orderBy("t")
    whole = Window.partitionBy(image)
    s = h.select(
        image, "t", F.sum("n").over(upto).cast("double").alias("w"), F.sum(F.col("n") * F.col("t")).over(upto).cast("double").alias("m"),
        F.sum("n").over(whole).cast("double").alias("w_all"), F.sum(F.col("n") * F.col("t")).over(whole).cast("double").alias("m_all"),
    )
    between = F.when(F.col("w") < F.col("w_all"), F.pow(F.col("m_all") * F.col("w") / F.col("w_all") - F.col("m"), F.lit(2.0)) / (F.col("w") * (F.col("w_all") - F.col("w"))))
    best = s.withColumn("v", F.round(between, 9)).groupBy(image).agg(F.min_by("t", F.struct(-F.coalesce("v", F.lit(-1.0)), F.col("t"))).alias("threshold"))
    return best


def stretched(c: Column, black: int, white: int) -> Column:
    """Levels of a column of values, without gamma, rounded half up."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (c - black) * 255.0 / max(1, white - black))) + 0.5).cast("int")
