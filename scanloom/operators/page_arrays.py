"""Matching of the boxes of whole pages as arrays, for tasks that hold all rows of their pages: nothing is shuffled between the steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Boxes of a page up to which all of them are compared; pages of more are cut into cells.
FEW_BOXES = 256
#: Pairs compared at once.
PAIRS_AT_ONCE = 2_000_000


def overlap_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``layout.overlap_ratio`` of rows of (x, y, w, h); NaN stands for null, which least and greatest pass over."""
    w = np.fmax(0.0, np.fmin(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.fmax(a[:, 0], b[:, 0]))
    h = np.fmax(0.0, np.fmin(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.fmax(a[:, 1], b[:, 1]))
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - w * h
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, w * h / union, 0.0)


def _together(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of equal keys, in blocks of about PAIRS_AT_ONCE."""
    order = np.argsort(b, kind="stable")
    keys = b[order]
    first = np.searchsorted(keys, a, "left")
    n = np.searchsorted(keys, a, "right") - first
    ends = np.cumsum(n)
    at = 0
    while at < len(a):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        c = n[at:to]
        left = np.repeat(np.arange(at, to), c)
        yield left, order[np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:to], c)]
        at = to


def _cells(page: np.ndarray, box: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, (page, x, y) of a cell) for every cell that a box touches; boxes that aren't complete touch none."""
    rows = np.flatnonzero(np.isfinite(box).all(axis=1))
    lo, hi = np.floor(box[rows, :2] / cell).astype("int64"), np.floor((box[rows, :2] + box[rows, 2:]) / cell).astype("int64")
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    wide = hi[:, 0] - lo[:, 0] + 1
    n = wide * (hi[:, 1] - lo[:, 1] + 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = np.repeat(np.arange(len(rows)), n)
    return rows[i], np.column_stack([page[rows][i], lo[i, 0] + k % wide[i], lo[i, 1] + k // wide[i]])


def near_pairs(page_a: np.ndarray, box_a: np.ndarray, page_b: np.ndarray, box_b: np.ndarray, min_ratio: float = 0.5, cell: float = 256.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``layout.match_boxes`` as (rows of a, rows of b, ratios). Pages are numbered from 0."""
    if min_ratio <= 0:
        raise ValueError("min_ratio must be above 0; all pairs would match")
    out = []

    def keep(i: np.ndarray, j: np.ndarray, here: np.ndarray | None = None) -> None:
        iou = overlap_ratios(box_a[i], box_b[j])
        ok = iou >= min_ratio if here is None else (iou >= min_ratio) & here
        out.append((i[ok], j[ok], iou[ok]))

    pages = 1 + max(page_a.max(initial=-1), page_b.max(initial=-1))
    many = np.maximum(np.bincount(page_a, minlength=pages), np.bincount(page_b, minlength=pages)) > FEW_BOXES
    a, b = np.flatnonzero(~many[page_a]), np.flatnonzero(~many[page_b])
    for i, j in _together(page_a[a], page_b[b]):
        keep(a[i], b[j])
    if many.any():
        a, b = np.flatnonzero(many[page_a]), np.flatnonzero(many[page_b])
        (ra, ca), (rb, cb) = _cells(page_a[a], box_a[a], cell), _cells(page_b[b], box_b[b], cell)
        key = np.unique(np.concatenate([ca, cb]), axis=0, return_inverse=True)[1].reshape(-1)
        for i, j in _together(key[: len(ca)], key[len(ca) :]):
            x, y = a[ra[i]], b[rb[j]]
            corner = np.floor(np.maximum(box_a[x, :2], box_b[y, :2]) / cell)
            keep(x, y, (corner == ca[i, 1:]).all(axis=1))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, "int64") for k in range(3))


def match_states(hypotheses: np.ndarray, regions: np.ndarray, ratios: np.ndarray, manual: np.ndarray, type_equal: np.ndarray) -> np.ndarray:
    """``layout.match_states`` of pairs of rows: AMBIGUOUS, CONFLICT or MATCHED."""
    several = (np.bincount(hypotheses)[hypotheses] > 1) | (np.bincount(regions)[regions] > 1)
    return np.where(several, "AMBIGUOUS", np.where(manual & (~type_equal | (ratios < 1.0)), "CONFLICT", "MATCHED"))
