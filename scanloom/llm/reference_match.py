"""Freely entered values mapped to the entries of a reference list.

A prefix-filter set-similarity join over character pairs: tokens are ordered by
their rarity in both sides, only rare prefixes are joined, lengths and positions
rule out more. Of the entries near enough the one with the fewest edits is
kept, of several the one with the highest Jaccard similarity, computed exactly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.patterns import let
from scanloom.session import materialise

#: A value farther from every entry than this share of its length is on no entry.
MAX_DISTANCE = 0.27
#: Values of fewer letters must equal an entry.
MIN_LETTERS = 4
#: What is added to the distance of a form cut short from the beginning of an entry.
CUT_SHORT = 0.01
#: Most prefix tokens of a reference list that are broadcast; beyond it they are joined by sort.
MAX_BROADCAST_ROWS = 1_000_000
#: Pairs whose edits are counted in one step.
PAIRS_AT_ONCE = 4096

# Words around a medicine's name in entries of either script.
DOSE_FORMS = ("inj", "tab", "tabs", "cap", "caps", "syr", "syrup", "amp", "drops", "susp", "cream", "oint", "gel", "spray", "supp", "شراب", "حبوب", "كبسوله", "كبسولات", "حقنه", "قطره", "مرهم", "اقراص", "قرص")
FREQUENCIES = ("od", "bid", "bd", "tid", "tds", "qid", "prn", "sos", "hs", "stat", "daily", "nocte", "يوميا")
UNITS = ("mg", "ml", "mcg", "ug", "iu", "g", "gm", "mmol", "units", "ملغ", "مل", "مكغ", "غرام", "مجم", "وحده")
# Signs written for letters, and letters of one sound.
MISTYPED = {"0": "o", "1": "l", "!": "i", "@": "a", "$": "s", "5": "s", "8": "b"}
LATIN_SOUNDS = (("ph", "f"), ("y", "i"), ("e", "i"), ("u", "o"), ("c", "k"), ("q", "k"), ("z", "s"), ("v", "f"))
ARABIC_SOUNDS = (("ق", "ك"),)
ARABIC_SHAPES = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ـ": ""}
DIGITS = {chr(0x660 + k): str(k) for k in range(10)} | {chr(0x6F0 + k): str(k) for k in range(10)}

_SIGNS = str.maketrans(ARABIC_SHAPES | DIGITS)
_MISTYPED = str.maketrans(MISTYPED)
_FORM = re.compile(rf"^(?:{'|'.join(DOSE_FORMS)})\.?\s+")
_TAIL = re.compile(rf"\s+(?:{'|'.join(FREQUENCIES)}|x\s?\d+)\.?$")
_DOSE = re.compile(rf"\s*\d+(?:[.,/]\d+)*\s*(?:{'|'.join(UNITS)})\.?$")
_MARKS = re.compile(r"[ً-ْٰ]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"(.)\1+")
_NEAR = pa.schema([("form", pa.string()), ("short", pa.bool_()), ("entry", pa.string()), ("d", pa.float64())])


def name_form(value: str) -> tuple[str, bool]:
    """(letters of the name as they sound, whether it is cut short by a full stop).

    Dose form, frequency and dose are removed, spaces and hyphens inside too,
    runs of one letter become one, and letters of one sound become one.
    """
    s = _MARKS.sub("", unicodedata.normalize("NFKC", value).lower().translate(_SIGNS)).strip()
    s = _FORM.sub("", s, count=1)
    s = _DOSE.sub("", _TAIL.sub("", s))
    short = s.endswith(".")
    s = _NO_LETTER.sub("", s.translate(_MISTYPED))
    if re.search("[a-z]", s):
        for a, b in LATIN_SOUNDS:
            s = s.replace(a, b)
    else:
        s = re.sub("^ال", "", s)
        for a, b in ARABIC_SOUNDS:
            s = s.replace(a, b)
    return _RUN.sub(r"\1", s), short


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; ``most`` + 1 if more."""
    return int(min(edits_of([a], [b])[0], most + 1))


def edits_of(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours from each a to its b; a step of the table is taken for all pairs at once."""
    na, nb = np.array([len(x) for x in a], np.int32), np.array([len(x) for x in b], np.int32)
    if not len(na):
        return na
    x = np.zeros((int(na.max()) + 1, len(a)), np.int32)
    y = np.zeros((int(nb.max()) + 1, len(b)), np.int32)
    for k, (s, t) in enumerate(zip(a, b)):
        x[1 : len(s) + 1, k] = np.frombuffer(s.encode("utf-32-le"), np.int32)
        y[1 : len(t) + 1, k] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    rows = np.repeat(np.arange(len(y), dtype=np.int32)[:, None], len(a), 1)
    before = last = rows
    out = np.where(na == 0, nb, 0)
    at = np.arange(len(a))
    for i in range(1, len(x)):
        new = np.empty_like(rows)
        new[0] = i
        for j in range(1, len(y)):
            d = np.minimum(np.minimum(last[j], new[j - 1]) + 1, last[j - 1] + (x[i] != y[j]))
            if i > 1 and j > 1:
                d = np.where((x[i] == y[j - 1]) & (x[i - 1] == y[j]), np.minimum(d, before[j - 2] + 1), d)
            new[j] = d
        before, last = last, new
        out = np.where(na == i, new[nb, at], out)
    return out


def distances(form: Sequence[str], short: Sequence[bool], entry: Sequence[str]) -> np.ndarray:
    """Edits as a share of the longer length; a cut-short form is also held against the beginning of the entry."""
    size = np.array([max(len(a), len(b), 1) for a, b in zip(form, entry)])
    found = edits_of(form, entry) / size
    cut = [k for k, (a, s, b) in enumerate(zip(form, short, entry)) if s and len(a) < len(b)]
    for k in (-1, 0, 1):
        heads = [entry[i][: len(form[i]) + k] for i in cut]
        length = np.array([max(1, len(form[i])) for i in cut])
        found[cut] = np.minimum(found[cut], edits_of([form[i] for i in cut], heads) / length + CUT_SHORT)
    return found


def most_edits(size: int, share: float) -> int:
    return int(share * size + 1e-9)


@cache
def least_shared(length: int, short: bool, share: float) -> int:
    """How many neighbouring pairs of a form of ``length`` letters an entry within ``share`` keeps, at least.

    With its marks a form has one pair more than letters. An insertion breaks
    one pair, a deletion two, a substitution two and a swap three.
    """
    if short:
        heads = length - 3 * most_edits(length, share - CUT_SHORT)
        return max(0, min(heads, least_shared(length, False, share) - 1))
    least = length + 1 - 3 * most_edits(length, share)
    longer = length + 1
    while longer - length <= most_edits(longer, share):
        inserted = longer - length
        least = min(least, length + 1 - inserted - 3 * (most_edits(longer, share) - inserted))
        longer += 1
    return max(0, least)


def with_form(df: DataFrame, value: str, share: float = MAX_DISTANCE) -> DataFrame:
    """``df`` with ``form`` and ``short`` of ``name_form`` and ``least`` of ``least_shared``."""

    @F.pandas_udf("form string, short boolean, least int")
    def forms(s: pd.Series) -> pd.DataFrame:
        found = [name_form(x) for x in s]
        return pd.DataFrame([(f, short, least_shared(len(f), short, share)) for f, short in found], columns=["form", "short", "least"])

    return df.withColumn("_f", forms(F.col(value))).select("*", "_f.form", "_f.short", "_f.least").drop("_f")


def character_pairs(form: Column, short: Column) -> Column:
    """The neighbouring characters with marks at the beginning and, if not cut short, the end; the second "an" is another token than the first."""
    s = F.concat(F.lit("^"), form, F.when(short, F.lit("")).otherwise(F.lit("$")))

    def numbered(pairs: Column) -> Column:
        before = lambda x, i: F.size(F.filter(F.slice(pairs, 1, i), lambda y: y == x))
        return F.transform(pairs, lambda x, i: F.concat(x, before(x, i).cast("string")))

    return let(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 1)), lambda i: F.substring(s, i, F.lit(2))), numbered)


def _prefixes(side: DataFrame, rarity: DataFrame, name: str) -> DataFrame:
    """(name, n, p, t) of the tokens, from rare to frequent, up to the place at which ``least`` shared ones must have begun."""
    e = side.select("id", "least", F.explode("tokens").alias("t")).join(rarity, "t")
    ordered = e.groupBy("id", "least").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("x"))
    n = F.size("x")
    p = ordered.select("id", n.alias(f"n{name}"), F.posexplode(F.slice("x.t", F.lit(1), F.least(n, n - F.col("least") + 1))).alias(f"p{name}", "t"))
    return p.withColumnRenamed("id", name)


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``l``, ``r``, ``nl``, ``nr``, ``most``) of the pairs of (id, tokens, least) rows that share a token of their prefixes.

    Two rows that share as many tokens as both ``least`` ask for share one of
    the first n - least + 1, counted from the rarest of both sides. ``most`` is
    how many they can share with this token at these places. A pair stands here
    once for each such token. A right side of at most ``MAX_BROADCAST_ROWS``
    prefix tokens is broadcast; a larger one is joined by sort, where adaptive
    execution splits tokens that many rows share.
    """
    rarity = left.select(F.explode("tokens").alias("t")).unionAll(right.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))
    rarity = materialise(rarity)
    a, b = _prefixes(left, rarity, "l"), materialise(_prefixes(right, rarity, "r"))
    b = F.broadcast(b) if b.count() <= MAX_BROADCAST_ROWS else b.hint("merge")
    # Few bytes but much work: spread by number, not by size.
    tasks = 4 * max(1, left.sparkSession.sparkContext.defaultParallelism)
    most = F.least("pl", "pr") + F.least(F.col("nl") - F.col("pl"), F.col("nr") - F.col("pr"))
    return a.repartition(tasks, "l").join(b, "t").select("l", "r", "nl", "nr", most.alias("most"))


def with_jaccard(pairs: DataFrame, tokens: DataFrame, other: DataFrame) -> DataFrame:
    """``pairs`` of (l, r) with the exact ``jaccard`` of their tokens."""
    both = pairs.join(tokens.select(F.col("id").alias("l"), F.col("tokens").alias("tl")), "l").join(other.select(F.col("id").alias("r"), F.col("tokens").alias("tr")), "r")
    common = F.size(F.array_intersect("tl", "tr"))
    return both.withColumn("jaccard", common / (F.size("tl") + F.size("tr") - common)).drop("tl", "tr")


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(``l``, ``r``, ``jaccard``) of the pairs of (id, tokens) rows that reach ``threshold``; exact."""
    a, b = (side.withColumn("least", F.ceil(F.lit(threshold) * F.size("tokens") - F.lit(1e-9)).cast("int")) for side in (left, right))
    need = F.lit(threshold / (1 + threshold)) * (F.col("nl") + F.col("nr")) - 1e-9
    fits = (F.least("nl", "nr") >= F.lit(threshold) * F.greatest("nl", "nr") - 1e-9) & (F.col("most") >= need)
    return with_jaccard(prefix_pairs(a, b).where(fits).select("l", "r").distinct(), a, b).where(F.col("jaccard") >= threshold)


def _near(pairs: DataFrame, max_distance: float) -> DataFrame:
    """(``l``, ``r``, ``d``) of the candidate pairs (l, r) that are near enough, each once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            got = sorted(got, key=lambda x: (len(x[0]), len(x[2])))
            for at in range(0, len(got), PAIRS_AT_ONCE):
                form, short, entry = zip(*got[at : at + PAIRS_AT_ONCE])
                d = distances(form, short, entry)
                keep = [k for k in np.flatnonzero(d <= max_distance) if len(form[k]) >= MIN_LETTERS or d[k] == 0]
                yield pa.RecordBatch.from_pylist([{"form": form[k], "short": short[k], "entry": entry[k], "d": float(d[k])} for k in keep], _NEAR)

    found = pairs.select("l.form", "l.short", F.col("r.form").alias("entry")).mapInArrow(run, "form string, short boolean, entry string, d double")
    return found.select(F.struct("form", "short").alias("l"), F.struct(F.col("entry").alias("form"), F.lit(False).alias("short")).alias("r"), "d")


def map_to_reference(df: DataFrame, key: str, value: str, reference: DataFrame, entry: str, spelling: str, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(``key``, ``entry``): the reference entry each value means, or -1 if it means none.

    ``reference`` has one or more ``spelling`` rows for an ``entry`` number;
    null and blank spellings are left out, repeated ones count once. Rows whose
    value is null or blank give no row; exact repeats of (key, value) count
    once. Entries within ``max_distance`` are all found: how many pairs of
    neighbouring letters they must share follows from the edits allowed. Of
    them the one with the fewest edits, then the highest Jaccard similarity,
    then the smallest number is taken. Each different form is matched once.
    """
    items = df.select(F.col(key), F.col(value).cast("string").alias("_v")).where("_v is not null").distinct()
    items = materialise(with_form(items, "_v", max_distance).where(r"_v rlike '[^\\s\\u00a0\\u200b-\\u200f\\u2060\\ufeff]'"))
    forms = items.where("form != ''").select("form", "short", "least").distinct().withColumn("id", F.struct("form", "short"))
    spelled = reference.select(F.col(entry).cast("int").alias("e"), F.trim(F.col(spelling).cast("string")).alias("s")).where("s is not null and s != '' and e is not null").distinct()
    entries = materialise(with_form(spelled, "s", max_distance).where("form != ''").groupBy("form", "least").agg(F.min("e").alias("e")))

    probes = materialise(forms.select("id", "least", character_pairs(F.col("form"), F.col("short")).alias("tokens")))
    known = entries.select(F.struct("form", F.lit(False).alias("short")).alias("id"), "least", character_pairs(F.col("form"), F.lit(False)).alias("tokens"))
    # A cut-short form may share few pairs with a long entry, so it meets all pairs of an entry.
    whole = known.withColumn("least", F.lit(0))
    a, b = F.length("l.form"), F.length("r.form")
    most = F.floor(F.lit(max_distance) * F.greatest(a, b) + 1e-9)
    full = prefix_pairs(probes.where("not id.short"), known).where((F.abs(a - b) <= most) & (F.col("most") >= F.greatest("nl", "nr") - 3 * most))
    cut = prefix_pairs(probes.where("id.short"), whole).where((a - b <= most) & (F.col("most") >= F.col("nl") - 1 - 3 * most))
    near = materialise(_near(full.unionByName(cut), max_distance).distinct())
    ranked = with_jaccard(near, probes, known).join(entries.select(F.struct("form", F.lit(False).alias("short")).alias("r"), "e"), "r")
    best = ranked.groupBy("l").agg(F.min(F.struct("d", (-F.col("jaccard")).alias("j"), "e")).alias("b")).select(F.col("l.form").alias("form"), F.col("l.short").alias("short"), F.col("b.e").alias("e"))
    return items.join(best, ["form", "short"], "left").select(F.col(key), F.coalesce("e", F.lit(-1)).cast("int").alias(entry))
