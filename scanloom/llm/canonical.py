"""One consistent form for texts that look the same but differ in their characters.

A mapping from source sequences (single characters, letters with their marks in
any composition, conjoining letters) to target sequences is derived from Unicode
data and a short list of look-alike letters, checked for conflicts, and compiled
into a longest-match transducer over grapheme clusters (a base character and the
marks that follow it). A text is rewritten in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.blocks import meets, pair_blocks
from scanloom.session import materialise

# Letters and digits of other scripts that have the shape of the one on the right.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    # Extended Arabic-Indic digits; four, five and six have another shape.
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
    # Latin letters of the same shape
    "ɑ": "a", "ɡ": "g", "ı": "i", "ǀ": "l",
}
# Hyphens of the shape of "-"; dashes are longer and stay.
HYPHENS = "‐‑﹣－"
# Decomposition tags whose characters keep the look of their decomposition.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
INVISIBLE_CATEGORIES = ("Cf",)
#: Format characters that do show: Arabic number and verse signs.
VISIBLE_FORMAT = frozenset("؀؁؂؃؄؅۝܏࣢")
VARIATION_SELECTORS = frozenset([*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x3164])
#: Planes in which characters have rules: the first two, compatibility ideographs, tags and further variation selectors.
PLANES = (range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000))
TOP = 0xE1000
HANGUL_LETTERS, HANGUL = range(0x1100, 0x1200), range(0xAC00, 0xD7A4)


class ConflictError(ValueError):
    """Two rules give different results for one source sequence, or a result is itself rewritten."""


def _compose(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def single_rules() -> dict[str, str]:
    """Source character to target sequence."""
    single: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source != target and single.setdefault(source, target) != target:
            raise ConflictError(f"{source!r}: {single[source]!r} and {target!r}")

    for code in (c for plane in PLANES for c in plane):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in INVISIBLE_CATEGORIES and c not in VISIBLE_FORMAT or code in VARIATION_SELECTORS:
            put(c, "")
        elif kind == "Zs":
            put(c, " ")
        elif c in HYPHENS:
            put(c, "-")
        elif c in LOOK_ALIKES:
            put(c, LOOK_ALIKES[c])
        elif (found := unicodedata.decomposition(c)) and found.startswith("<"):
            if found.split()[0] in SAME_LOOK_TAGS:
                target = unicodedata.normalize("NFKC", c)
                if not (target[:1] == " " and any(unicodedata.combining(x) for x in target)):
                    put(c, target)
        elif found and _compose(c) != c:
            put(c, _compose(c))  # singleton or excluded composition
    # A composed letter whose base has the shape of another: that one with the same marks.
    for code in (c for plane in PLANES for c in plane):
        c = chr(code)
        if c not in single and (parts := unicodedata.normalize("NFD", c))[0] in single and len(parts) > 1:
            put(c, _compose("".join(single.get(x, x) for x in parts)))
    out: dict[str, str] = {}
    for source, target in single.items():
        for _ in range(3):
            target = _compose("".join(single.get(x, x) for x in target))
        out[source] = target
    for source, target in out.items():
        if any(x in out for x in target) or _compose(target) != target:
            raise ConflictError(f"{source!r} gives {target!r}, which is rewritten again")
    return out


@cache
def mapping() -> dict[str, str]:
    """Source sequence to target sequence, closed under its own rules.

    To the rules of single characters come the sequences that compose: a letter
    and marks, also where the letter is a look-alike or a width form, and
    conjoining letters. Raises ConflictError if rules contradict each other or
    if applying the mapping to one of its results would change it.
    """
    single = single_rules()
    out = dict(single)

    def put(source: str, target: str) -> None:
        if out.setdefault(source, target) != target:
            raise ConflictError(f"{source!r}: {out[source]!r} and {target!r}")

    variants: dict[str, list[str]] = {}
    for source, target in single.items():
        if len(target) == 1:
            variants.setdefault(target, []).append(source)
    for code in (c for plane in PLANES for c in plane):
        c = chr(code)
        if c in single or not (found := unicodedata.decomposition(c)) or found.startswith("<"):
            continue
        parts = unicodedata.normalize("NFD", c)
        if _compose(parts) == c and len(parts) > 1:
            put(parts, c)
            for v in variants.get(parts[0], ()):
                put(v + parts[1:], c)
            # A composed letter and a further mark.
            for k in range(2, len(parts)):
                head = _compose(parts[:k])
                if len(head) == 1:
                    put(head + parts[k:], c)
    for code in HANGUL:
        parts = unicodedata.normalize("NFD", chr(code))
        put(parts, chr(code))
        if len(parts) > 2:
            put(_compose(parts[:2]) + parts[2:], chr(code))
    for source, target in out.items():
        if target in out:
            raise ConflictError(f"{source!r} gives {target!r}, which is rewritten again")
    return out


class Transducer:
    """Longest match of compiled source sequences over grapheme clusters.

    The sources are compiled into a trie of states. A cluster's marks are put
    in canonical order, then the longest source from each place on is
    rewritten; what a result ends in is matched again with marks left over. The
    result of a cluster is kept, as a state that is added when it is met.
    """

    def __init__(self, rules: dict[str, str] | None = None) -> None:
        self.rules = mapping() if rules is None else rules
        self.states: dict[str, dict] = {}
        for source, target in self.rules.items():
            node = self.states
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        marks = "".join(self._ranges(lambda c: unicodedata.combining(c) > 0))
        singles = "".join(self._ranges(lambda c: c in self.rules))
        hangul = f"{chr(HANGUL_LETTERS[0])}-{chr(HANGUL_LETTERS[-1])}{chr(HANGUL[0])}-{chr(HANGUL[-1])}"
        invisible = "".join(self._ranges(lambda c: self.rules.get(c) == ""))
        # A cluster that needs work: conjoining letters, a base with marks (invisible characters may stand between), a mapped character.
        self.scan = re.compile(f"[{hangul}][{hangul}{invisible}]+|[^{marks}\\n][{invisible}]*[{marks}][{marks}{invisible}]*|[{singles}]")
        self.hidden = re.compile(f"[{invisible}]+")
        self.starts = frozenset(chr(c) for plane in PLANES for c in plane if unicodedata.combining(chr(c)) or chr(c) in self.rules or c in HANGUL_LETTERS)
        self.memo: dict[str, str] = {}

    @staticmethod
    def _ranges(test) -> Iterator[str]:
        for plane in PLANES:
            start = None
            for code in range(plane[0], plane[-1] + 2):
                inside = code in plane and not 0xD800 <= code <= 0xDFFF and test(chr(code))
                if inside and start is None:
                    start = code
                elif not inside and start is not None:
                    yield re.escape(chr(start)) + ("-" + re.escape(chr(code - 1)) if code - 1 > start else "")
                    start = None

    def longest(self, text: str, at: int) -> tuple[int, str | None]:
        """(end, target) of the longest source at this place; (at, None) if there is none."""
        node, end, target = self.states, at, None
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if "" in node:
                end, target = k + 1, node[""]
        return end, target

    def _rewritten(self, source: str) -> str:
        text = unicodedata.normalize("NFD", self.hidden.sub("", source))
        out, at = "", 0
        while at < len(text):
            end, target = self.longest(text, at)
            if target is None:
                out, at = out + text[at], at + 1
            elif end < len(text) and len(target) > 1 and unicodedata.combining(text[end]):
                out, text, at = out + target[:-1], target[-1] + text[end:], 0  # marks may join the last letter
            else:
                out, at = out + target, end
        return out

    def _cluster(self, match: re.Match) -> str:
        source = match[0]
        target = self.memo.get(source)
        if target is None:
            target = self._rewritten(source)
            if len(self.memo) < 100_000:
                self.memo[source] = target
        return target

    def __call__(self, text: str) -> str:
        return text if text.isascii() or self.starts.isdisjoint(text) else self.scan.sub(self._cluster, text)


@cache
def transducer() -> Transducer:
    return Transducer()


def canonical(column: Column) -> Column:
    """The consistent form of a string column; null stays null, empty stays empty.

    Width forms, composed and combined accents, ligatures, presentation forms,
    invisible characters, kinds of spaces and hyphens, and letters or digits of
    the same shape are unified. Letter case, accents, hamza, the value of
    digits and other punctuation are kept. Idempotent.
    """

    @F.pandas_udf("string")
    def rewrite(s):
        run = transducer()
        return s.map(run, na_action="ignore")

    return rewrite(column)


def with_canonical(df: DataFrame, field: str, out: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of ``field`` in ``out`` (a column of that name is replaced). No shuffle."""
    return df.withColumn(out, canonical(F.col(field)))


def _digest(column: Column) -> Column:
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def look_same_forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(``fld``, ``key``, ``value``, ``form``) of the rows' values that are not null, the last two as digests of 128 bits.

    Exact repeats of a key and value count once. No text is shuffled.
    """
    stacked = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x"))
    rows = stacked.where("key is not null and x.v is not null").select("x.fld", "key", "x.v")
    return rows.select("fld", "key", _digest(F.col("v")).alias("value"), _digest(canonical(F.col("v"))).alias("form")).distinct()


def pairs_of_forms(forms: DataFrame) -> DataFrame:
    """(``fld``, ``key_a``, ``key_b``): rows of ``look_same_forms`` of one field, smaller key first, with one form and different values.

    Only forms with at least two different values go on. Groups of any size
    are compared in blocks of bounded size; the number of rows is that of the
    pairs that exist.
    """
    forms = materialise(forms)
    several = forms.groupBy("fld", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    spread = pair_blocks(forms, ["fld", "form"], F.col("key"), several)
    keys = ["fld", "form", "_lo", "_hi"]
    a = spread.select(*keys, F.col("_part").alias("pa"), F.col("key").alias("key_a"), F.col("value").alias("va"))
    b = spread.select(*keys, F.col("_part").alias("pb"), F.col("key").alias("key_b"), F.col("value").alias("vb"))
    both = a.join(b.hint("merge"), keys).where((F.col("key_a") < F.col("key_b")) & (F.col("va") != F.col("vb")) & meets(F.col("pa"), F.col("pb"), F.col("_lo"), F.col("_hi")))
    return both.select("fld", "key_a", "key_b").distinct()


def look_same_pairs(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(``fld``, ``key_a``, ``key_b``): two rows, smaller key first, whose values of a field look the same but are different strings."""
    return pairs_of_forms(look_same_forms(df, key, list(fields)))


def canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The consistent form of a one-column record batch, for use outside Spark."""
    run = transducer()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else run(x) for x in batch.column(0).to_pylist()], pa.string())], names=["canonical"])
