"""Error rates and similarities of pairs of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scanloom.functions.patterns import SPACE, let, strip, words


def cer(ref: Column, hyp: Column) -> Column:
    """struct(edits, n, cer): character edits over the reference's length; an empty reference gives 0 or 1."""
    e, n = F.levenshtein(ref, hyp), F.length(ref)
    return F.struct(e.alias("edits"), n.alias("n"), F.when(n > 0, e / n).otherwise(F.when(F.length(hyp) > 0, 1.0).otherwise(0.0)).alias("cer"))


def _coded(a: Column, vocabulary: Column) -> Column:
    """Words as single characters beyond the basic plane, by their place in the vocabulary; there are 1 048 576."""
    return F.decode(F.unhex(F.array_join(F.transform(a, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0xFFFF), 8, "0")), "")), "UTF-32")


def wer(ref: Column, hyp: Column) -> Column:
    """struct(edits, n, wer): word edits over the reference's words, for texts of up to 1 048 576 different words together."""

    def of(p: Column) -> Column:
        v = F.array_distinct(F.concat(p["r"], p["h"]))
        n = F.size(p["r"])
        e = let(v, lambda v: F.levenshtein(_coded(p["r"], v), _coded(p["h"], v)))
        return F.struct(e.alias("edits"), n.alias("n"), F.when(n > 0, e / n).otherwise(F.when(F.size(p["h"]) > 0, 1.0).otherwise(0.0)).alias("wer"))

    return let(F.struct(words(ref).alias("r"), words(hyp).alias("h")), of)


def character_wer(ref: Column, hyp: Column) -> Column:
    """The older word error rate: character edits of the joined words over the number of words, which may exceed 1."""

    def of(p: Column) -> Column:
        e = F.levenshtein(F.array_join(p["r"], " "), F.array_join(p["h"], " "))
        return F.when(F.size(p["r"]) > 0, e / F.size(p["r"])).otherwise(F.when(F.size(p["h"]) > 0, 1.0).otherwise(0.0))

    return let(F.struct(words(ref).alias("r"), words(hyp).alias("h")), of)


def edit_counts(ref: str, hyp: str) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions); equal characters use the diagonal, then substitution, deletion, insertion."""
    n, m = len(ref), len(hyp)
    table = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, last = [i], table[-1]
        for j in range(1, m + 1):
            row.append(last[j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(last[j - 1], last[j], row[-1]))
        table.append(row)
    i, j, s, d, k = n, m, 0, 0, 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif table[i][j] == table[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d + i, k + j


_COUNTS = StructType([StructField(n, IntegerType()) for n in ("substitutions", "deletions", "insertions")])


def sdi(ref: Column, hyp: Column) -> Column:
    """struct(substitutions, deletions, insertions) of the characters. The table is quadratic in the length: for lines and short texts."""

    @F.pandas_udf(_COUNTS)
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 3 if x is None or y is None else edit_counts(x, y) for x, y in zip(a, b)], columns=["substitutions", "deletions", "insertions"])

    return count(ref, hyp)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common length over both lengths; 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


def set_ratio(a: str, b: str) -> float:
    """0 to 100: the best ratio among the shared words and the shared words with either rest; 100 where one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    rest_a, rest_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not rest_a or not rest_b):
        return 100.0
    one, two = f"{both} {rest_a}".strip(), f"{both} {rest_b}".strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def _pair_udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    return _pair_udf(ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pair_udf(set_ratio)(a, b)


def validity(c: Column) -> Column:
    """The share of letters, white space and Arabic characters in the stripped text."""
    return let(strip(c), lambda t: F.when(F.length(t) > 0, F.length(F.regexp_replace(t, rf"[^\p{{L}}{SPACE}؀-ۿ]", "")) / F.length(t)).otherwise(0.0))


def composite(confidence: Column, text: Column, failed: Column) -> Column:
    """Confidence times length times validity, a tenth of it where recognition failed."""
    value = confidence * F.length(strip(text)) * validity(text)
    return F.when(failed, value * 0.1).otherwise(value)


def digit_runs_kept(before: Column, after: Column) -> Column:
    """Whether two texts hold the same runs of digits in the same order."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))
    return runs(before) == runs(after)


def guarded(before: Column, after: Column) -> Column:
    """struct(text, flag): a correction that changes digits is taken back and flagged."""
    ok = digit_runs_kept(before, after)
    return F.struct(F.when(ok, after).otherwise(before).alias("text"), F.when(~ok, "NUMERICAL_DRIFT_DETECTED").alias("flag"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def best_window(term: Column, text: Column) -> Column:
    """The smallest edit distance of a term to a run of about as many words of a text, or to its beginning; both lower case."""

    def of(p: Column) -> Column:
        n = F.size(p["t"])
        spans = F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), n - 1), n + 1), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p["w"]))), lambda i: i + k - 1 <= F.size(p["w"])), lambda i: F.levenshtein(p["term"], F.array_join(F.slice(p["w"], i, k), " ")))))
        return F.array_min(F.concat(spans, F.array(F.length(p["term"]), F.levenshtein(p["term"], F.substring(p["text"], F.lit(1), F.length(p["term"]))))))

    low = F.lower(text)
    return let(F.struct(F.lower(strip(term)).alias("term"), words(F.lower(strip(term))).alias("t"), words(low).alias("w"), low.alias("text")), of)
