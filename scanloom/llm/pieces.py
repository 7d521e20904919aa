"""Splitting of texts over a token limit at natural boundaries, with overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.bpe import CorpusEncoder, encoder, tokenizer_path

# Strength of a place to cut, from the characters before it.
PAGE, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 6, 5, 4, 3, 2, 1, 0

# Characters that end a sentence or a clause, and lines that separate sections.
SENTENCE_ENDS = ".!?؟。…"
CLAUSE_ENDS = ",;:،؛|"
RULE_CHARACTERS = "-=_*"

#: Share of a piece's new tokens around the target in which a stronger boundary is taken.
SNAP = 0.3


def strengths(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Strength of a cut before each word of one text; ``codes`` are its characters."""
    out = np.zeros(len(begin), np.int8)
    if len(begin) < 2:
        return out
    at = begin[1:]
    one = codes[at - 1]
    two = codes[np.maximum(at - 2, 0)]
    here = codes[at]
    blank = (here == 32) | (here == 9) | (here == 10) | (here == 13) | (here == 0xA0)
    after_space = (one == 32) | (one == 9) | (one == 0xA0)
    s = np.where(blank | after_space, WORD, INSIDE).astype(np.int8)
    s[blank & np.isin(one, [ord(c) for c in CLAUSE_ENDS])] = CLAUSE
    s[blank & np.isin(one, [ord(c) for c in SENTENCE_ENDS])] = SENTENCE
    newline = (one == 10) | (one == 13)
    s[newline & (here != 10)] = LINE
    s[newline & (here != 10) & ((two == 10) | np.isin(two, [ord(c) for c in RULE_CHARACTERS]))] = PARAGRAPH
    s[(one == 12) & (here != 12)] = PAGE
    out[1:] = s
    return out


def cut_points(total: np.ndarray, strength: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]] | None:
    """(first word, word after the last) of each piece, or None if no plan keeps the limit.

    ``total`` holds the tokens before each word and, last, of the whole. The
    fewest pieces that can do are tried first; their ends are spread evenly,
    each moved to the strongest boundary near it, the nearest of equals.
    """
    words, n = len(strength), int(total[-1])
    step = most - overlap
    least = 1 + math.ceil((n - most) / step)
    for k in range(least, least + max(8, least)):
        even = (n + (k - 1) * overlap) / k
        pieces, start, bad = [], 0, False
        for i in range(1, k + 1):
            limit = int(np.searchsorted(total, total[start] + most, "right")) - 1  # the last word boundary within the limit
            if limit >= words:
                pieces.append((start, words))
                break
            if i == k:
                bad = True
                break
            target = even + (i - 1) * (even - overlap)
            reach = SNAP * (even - overlap)
            before = pieces[-1][1] if pieces else 0
            lo = max(int(np.searchsorted(total, target - reach)), before + 1)
            hi = min(int(np.searchsorted(total, target + reach, "right")) - 1, limit)
            if hi < lo:
                lo = hi = limit
            if hi <= before:
                bad = True
                break
            window = strength[lo : hi + 1]
            best = np.flatnonzero(window == window.max()) + lo
            end = int(best[np.argmin(np.abs(total[best] - target))])
            pieces.append((start, end))
            start = max(int(np.searchsorted(total, total[end] - overlap, "right")) - 1, start + 1)
            if total[end] - total[start] > overlap * 2 and overlap:  # one word spans more than the overlap
                start = min(start + 1, end)
        if not bad:
            return pieces
    return None


def _fine_words(enc: CorpusEncoder, text: str, begin: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than an eighth of the limit cut into runs of few characters."""
    width = max(1, most // 64)
    b, c, end = [], [], np.append(begin[1:], len(text))
    for x, y, n in zip(begin, end, counts):
        if n > max(1, most // 8):
            cuts = list(range(int(x), int(y), width))
            b += cuts
            c += enc.count([text[p : min(p + width, int(y))] for p in cuts]).tolist()
        else:
            b.append(int(x))
            c.append(int(n))
    return np.array(b, np.int64), np.array(c, np.int64)


def split_text(enc: CorpusEncoder, text: str, begin: np.ndarray, counts: np.ndarray, most: int, overlap: int, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(first character, character after the last, tokens) of the pieces of a text over the limit.

    Each piece is encoded by itself and counted; where one exceeds the limit
    the plan is made again for a smaller one.
    """
    overlap = max(0, min(overlap, most // 2))
    if counts.max() > max(1, most // 8):
        begin, counts = _fine_words(enc, text, begin, counts, most)
    strength = strengths(codes, begin)
    total = np.concatenate([[0], np.cumsum(counts)])
    edge = np.append(begin, len(text))
    for aim in dict.fromkeys((most, most - 1, most - 2, most - most // 32 - 2, most - most // 8 - 2, most // 2, 1)):
        if aim < 1:
            continue
        found = cut_points(total, strength, aim, min(overlap, aim // 2)) if total[-1] > aim else [(0, len(strength))]
        if found is None:
            continue
        spans = [(int(edge[a]), int(edge[b])) for a, b in found]
        tokens = enc.count([text[a:b] for a, b in spans])
        if tokens.max() <= most:
            return [(a, b, int(t)) for (a, b), t in zip(spans, tokens)]
    # The limit is below the tokens of single characters: one character a piece.
    return [(k, k + 1, int(t)) for k, t in enumerate(enc.count(list(text)))]


def split_oversized(
    docs: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", path: str | None = None,
) -> DataFrame:
    """Ordered pieces of every text: (``key``, ``piece`` from 1, ``pieces``, ``first``, ``last``, ``n_tokens``, ``text``).

    ``limits`` has kind, max_tokens and overlap_tokens. A text within the limit
    of its kind, or of a kind without a limit, is one piece. Null and empty
    texts give no piece. ``first`` and ``last`` are character offsets (end
    exclusive); pieces cover the whole text and, but for the first, begin
    ``overlap_tokens`` before the end of the one before, or up to one word more.
    Pieces end at the strongest boundary near an even split; a run without
    boundaries is cut between characters. A character that alone has more
    tokens than the limit is a piece over it. Limits should be unique by kind; the largest
    ``max_tokens`` counts. Rows stay in place but for the join with ``limits``.
    """
    path = path or tokenizer_path()
    wide = limits.where("2 * overlap_tokens > max_tokens and max_tokens > 0").select("kind").first()
    if wide:
        raise ValueError(f"the overlap of {wide['kind']} is above half of its limit")
    small = limits.where("max_tokens > 0").groupBy(F.col("kind").alias("_kind")).agg(F.max_by(F.struct("max_tokens", "overlap_tokens"), "max_tokens").alias("_l"))
    rows = docs.select(F.col(key), F.col(kind).alias("_kind"), F.col(text).cast("string").alias("_text")).where("_text is not null and _text != ''")
    rows = rows.join(small, "_kind", "left").select(key, "_text", F.col("_l.max_tokens").cast("int").alias("_m"), F.coalesce("_l.overlap_tokens", F.lit(0)).cast("int").alias("_o"))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            most, overlap = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for chunk in enc.chunks(texts):
                part = [texts[k] for k in chunk]
                w = enc.words(part)
                counts = enc.counts[w.known]
                bounds = np.searchsorted(w.text_of, np.arange(len(part) + 1))
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                row, piece, pieces, first, last, tokens, out = [], [], [], [], [], [], []
                for i, k in enumerate(chunk):
                    lo, hi = bounds[i], bounds[i + 1]
                    n = int(counts[lo:hi].sum())
                    if most[k] is None or n <= most[k]:
                        spans = [(0, len(part[i]), n)]
                    else:
                        spans = split_text(enc, part[i], w.begin[lo:hi] - offsets[i], counts[lo:hi], most[k], overlap[k], codes[offsets[i] : offsets[i + 1]])
                    for j, (a, b, t) in enumerate(spans, 1):
                        row.append(k)
                        piece.append(j)
                        pieces.append(len(spans))
                        first.append(a)
                        last.append(b)
                        tokens.append(t)
                        out.append(part[i][a:b])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (piece, pieces, first, last, tokens)), pa.array(out, pa.string())],
                    names=[key, "piece", "pieces", "first", "last", "n_tokens", "text"],
                )

    return rows.mapInArrow(run, f"`{key}` {key_type}, piece int, pieces int, first int, last int, n_tokens int, text string")
