"""Noise of scanning in recognised text: running heads, page numbers, broken words, misread characters.

All lines of a text are turned into symbols by layout features (does the line
recur on other pages, is it a page number, is it a sentence) and labelled by a
hidden Markov model whose probabilities are fitted to the symbol sequences of
all texts. Misread words are those that a known confusion turns into a far more
usual word of the same corpus.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.canonical import transducer
from scanloom.session import materialise

# Intended characters and what recognition makes of them.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("i", "1"), ("l", "1"), ("o", "0"), ("a", "@"), ("s", "5"), ("g", "9"), ("b", "6"), ("l", "|"), ("i", "l"), ("i", "|"), ("i", "!"), ("l", "i"), ("h", "b"), ("c", "e"), ("o", "c"), ("z", "2"), ("b", "8"),
    ("d", "cl"), ("u", "ii"), ("h", "li"), ("m", "rn"), ("w", "vv"), ("ri", "n"), ("rn", "m"), ("ff", "fl"), ("fi", "fl"), ("fl", "fi"), ("in", "m"), ("nn", "rm"),
    ("ا", "1"), ("ي", "ب"), ("ر", "ز"), ("ن", "ت"), ("س", "ش"), ("ب", "ت"), ("د", "ذ"), ("ف", "ق"), ("ق", "ف"), ("ع", "غ"), ("ج", "ح"), ("ح", "خ"), ("ت", "ث"), ("ط", "ظ"), ("ص", "ض"), ("ه", "٥"), ("ة", "ه"),
    ("ب", "ي"), ("ز", "ر"), ("ت", "ن"), ("ش", "س"), ("ت", "ب"), ("ذ", "د"), ("غ", "ع"), ("ح", "ج"), ("خ", "ح"), ("ث", "ت"), ("ظ", "ط"), ("ض", "ص"), ("", "ـ"),
)
# Characters of confusable look written alike, to compare running heads.
ALIKE = {
    "e": "c", "t": "f", "l": "i", "1": "i", "|": "i", "!": "i", "0": "o", "@": "a", "5": "s", "9": "g", "6": "b", "d": "ci", "u": "ii", "h": "ii", "m": "rri", "n": "ri", "w": "vv", "ا": "i", "أ": "i", "إ": "i", "آ": "i", "ـ": "",
    "ت": "ب", "ث": "ب", "ن": "ب", "ي": "ب", "ى": "ب", "ئ": "ب", "ح": "ج", "خ": "ج", "ذ": "د", "ز": "ر", "ش": "س", "ض": "ص", "ظ": "ط", "غ": "ع", "ق": "ف", "ة": "ه", "٥": "ه",
}
BREAK_MARKS = "-­¬‐‑"
ADJOINING = ".,;:،؛؟?!()[]{}\"'«»“”…"
#: A word this many times rarer than the one a confusion leads to is taken for a misreading of it.
RARER, LEAST_COUNT = 20, 5
#: Most corrections that are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

_ALIKE = str.maketrans(ALIKE)
_PAGE = re.compile(r"(?:(page|pagc|p@ge|pa9e|p\.|p|صفحة|صفحه|ص)\s*)?[0-9٠-٩lI|O]{1,4}(?:\s*(?:/|of|من|0f|oj)\s*[0-9٠-٩lI|O]{1,4})?", re.I)
_DRESS = " \t[](){}-–—.·•"
_SENTENCE_END = tuple(".!?؟:,،;؛")

# States and symbols of the model.
STATES = ("top head", "top number", "body", "break", "bottom head", "bottom number", "page break")
FURNITURE = {"top head": "header", "bottom head": "header", "top number": "page_number", "bottom number": "page_number"}
RECURRING, RECURRING_SENTENCE, NUMBER, BARE_NUMBER, TEXT, BLANK, GAP, NEW_PAGE = "h", "r", "n", "b", "t", "_", "~", "f"
SYMBOLS = (RECURRING, RECURRING_SENTENCE, NUMBER, BARE_NUMBER, TEXT, BLANK, GAP, NEW_PAGE)
#: Before recurrence is known, a sentence's symbol; it becomes RECURRING_SENTENCE or TEXT.
SENTENCE = "s"
#: Lines of plain text and blank lines between them can only be body and break: one symbol, GAP, stands for them all.
_SURE = re.compile(f"{TEXT}[{TEXT}{BLANK}]*{TEXT}")


def head_key(line: str) -> str:
    """What the spellings of one running head share: no spaces, no appended page number, confusable characters alike."""
    line = line.rstrip()
    bare = line.rstrip("0123456789٠١٢٣٤٥٦٧٨٩")
    if 0 < len(line) - len(bare) <= 4 and len(bare) - len(bare.rstrip()) > 1:
        line = bare
    return "".join(line.casefold().split()).translate(_ALIKE)


def page_symbol(line: str) -> str | None:
    bare = line.strip(_DRESS)
    if not bare or not _PAGE.fullmatch(bare):
        return None
    plain = bare == line.strip()
    if plain and not any(c.isdigit() for c in bare):
        return None
    return BARE_NUMBER if plain and bare.isalnum() else NUMBER


#: Rounds of the model's fit.
ROUNDS = 3
_ENDS = pa.list_(pa.struct([("line_no", pa.int32()), ("left", pa.string()), ("right", pa.string())]))


class LineModel:
    """A left-to-right hidden Markov model over the symbols of a text's lines."""

    #: What follows what: furniture at the top, then text, then furniture at the bottom, then perhaps another page.
    NEXT = {
        "start": ("top head", "top number", "body", "break"),
        "top head": ("top head", "top number", "body", "break"),
        "top number": ("top head", "top number", "body", "break"),
        "body": ("body", "break", "bottom head", "bottom number", "page break", "end"),
        "break": ("body", "break", "bottom head", "bottom number", "page break", "end"),
        "bottom head": ("bottom head", "bottom number", "break", "page break", "end"),
        "bottom number": ("bottom head", "bottom number", "break", "page break", "end"),
        "page break": ("top head", "top number", "body", "break"),
    }
    #: Weights the fit starts from, in proportion.
    PRIOR = {
        "top head": {RECURRING: 96, RECURRING_SENTENCE: 1},
        "bottom head": {RECURRING: 96, RECURRING_SENTENCE: 1},
        "top number": {NUMBER: 90, BARE_NUMBER: 40},
        "bottom number": {NUMBER: 90, BARE_NUMBER: 40},
        "body": {TEXT: 90, RECURRING_SENTENCE: 5, RECURRING: 0.3, NUMBER: 0.3, BARE_NUMBER: 1, GAP: 60},
        "break": {BLANK: 100},
        "page break": {NEW_PAGE: 100},
    }

    def __init__(self) -> None:
        self.move = {a: {b: 1 / len(n) for b in n} for a, n in self.NEXT.items()}
        self.emit = {s: {x: w / sum(e.values()) for x, w in e.items()} for s, e in self.PRIOR.items()}

    def path(self, symbols: str) -> tuple[str, ...]:
        """The likeliest states; furniture is followed by nothing but furniture and blank lines up to the edge."""
        best = {"start": 0.0}
        back: list[dict[str, str]] = []
        for x in symbols:
            step: dict[str, float] = {}
            came: dict[str, str] = {}
            for a, score in best.items():
                for b, p in self.move[a].items():
                    e = self.emit.get(b, {}).get(x)
                    if e:
                        s = score + math.log(p) + math.log(e)
                        if b not in step or (s, a) > (step[b], came[b]):
                            step[b], came[b] = s, a
            best = step
            back.append(came)
        done = [(s + math.log(self.move[a].get("end", 1e-9)), a) for a, s in best.items()]
        if not done:
            return ("body",) * len(symbols)
        state = max(done)[1]
        states = []
        for came in reversed(back):
            states.append(state)
            state = came[state]
        return tuple(reversed(states))

    def tally(self, sequences: Iterable[tuple[str, int]]) -> dict[tuple[str, str, str], float]:
        """Counts along the likeliest paths: ("move", state, state) and ("emit", state, symbol)."""
        found: dict[tuple[str, str, str], float] = defaultdict(float)
        for symbols, n in sequences:
            states = self.path(symbols)
            for a, b in zip(("start", *states), (*states, "end")):
                found["move", a, b] += n
            for s, x in zip(states, symbols):
                found["emit", s, x] += n
            found["total", "", ""] += n
        return found

    def refit(self, tally: dict[tuple[str, str, str], float]) -> LineModel:
        """One round of Viterbi training: the counts, with the prior as pseudo-counts, replace the weights."""
        weight = max(1.0, tally.get(("total", "", ""), 0) / 100)

        def shares(kind: str, state: str, prior: dict[str, float]) -> dict[str, float]:
            seen = {x: tally.get((kind, state, x), 0.0) for x in prior}
            rest = sum(n for (k, a, _), n in tally.items() if k == kind and a == state)
            return {x: (seen[x] + weight * w) / (rest + weight * sum(prior.values())) for x, w in prior.items()}

        self.move = {a: shares("move", a, {b: 1.0 for b in n}) for a, n in self.NEXT.items()}
        self.emit = {s: shares("emit", s, {x: w / sum(e.values()) for x, w in e.items()}) for s, e in self.PRIOR.items()}
        return self

    def fit(self, sequences: dict[str, int], rounds: int = ROUNDS) -> LineModel:
        for _ in range(rounds):
            self.refit(self.tally(sequences.items()))
        return self


def fit_lines(sequences: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """The model fitted to all rows of (seq, n); each round gathers one row for each pair of states and state and symbol."""
    model = LineModel()
    for _ in range(rounds):
        move, emit = model.move, model.emit

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = LineModel()
            m.move, m.emit = move, emit
            found = m.tally((s, n) for batch in batches for s, n in zip(batch["seq"], batch["n"]))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "a", "b", "n"])

        tally = sequences.mapInPandas(count, "kind string, a string, b string, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        model.refit({(r["kind"], r["a"], r["b"]): r["n"] for r in tally.collect()})
    return model


def line_symbols(text: str) -> tuple[str, list[str | None]]:
    """(a symbol for each line, the key of each that may be a running head); a form feed gives a symbol of its own."""
    symbols, keys = [], []
    for x in text.split("\n"):
        if "\f" in x:
            symbols.append(NEW_PAGE)
            keys.append(None)
        key = None
        if not x or x.isspace():
            s = BLANK
        elif (s := page_symbol(x)) is None:
            key = head_key(x)
            s = TEXT if len(key) > 5 and not x.rstrip().endswith(_SENTENCE_END) and len(x.split()) > 1 else SENTENCE
        symbols.append(s)
        keys.append(key)
    return "".join(symbols), keys


def with_recurring(symbols: str, again: Iterable[int]) -> tuple[str, list[int]]:
    """(symbols now that it is known which lines recur, the line number of each; 0 where a symbol stands for several lines)."""
    hits = set(again)
    seen = "".join({TEXT: RECURRING, SENTENCE: RECURRING_SENTENCE}.get(c, c) if i in hits else (TEXT if c == SENTENCE else c) for i, c in enumerate(symbols))
    number, numbers = 0, []
    for c in seen:
        number += c != NEW_PAGE
        numbers.append(0 if c == NEW_PAGE else number)
    out, kept, at = [], [], 0
    for m in _SURE.finditer(seen):
        out += [seen[at : m.start()], GAP]
        kept += [*numbers[at : m.start()], 0]
        at = m.end()
    return "".join(out) + seen[at:], kept + numbers[at:]


def broken_ends(text: str) -> list[tuple[int, str, str]]:
    """(line number, left, right) of the words that may be broken at the end of a line."""
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines[:-1]):
        line = line.rstrip(" \t")
        if line[-1:] not in BREAK_MARKS or not (line[-2:-1].isalnum() or line[-2:-1] == "_"):
            continue
        following = lines[i + 1].split(None, 1)
        if not following:
            continue
        a, b = line[:-1].split()[-1].lstrip(ADJOINING), following[0].rstrip(ADJOINING)
        if a and b and a[-1].isalpha() and (b[0].isalpha() or b[0] in "1|@0" and len(b) > 1) and "@" not in a[:-1]:
            out.append((i + 1, a, b))
    return out


def scan_lines(texts: DataFrame) -> DataFrame:
    """(tbl, region_no, page_group, symbols, keys, broken) of each text: one pass for all that is read from lines.

    A key is a hash, 0 for none; page_group is hashed with tbl, null for none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            values = batch.column(3).to_pylist()
            found = [line_symbols(t) for t in values]
            hashes = [[xxhash.xxh3_64_intdigest(k) - 2**63 if k else 0 for k in keys] for _, keys in found]
            ends = [[{"line_no": i, "left": a, "right": b} for i, a, b in broken_ends(t)] for t in values]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([s for s, _ in found], pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(ends, _ENDS)],
                names=["tbl", "region_no", "page_group", "symbols", "keys", "broken"],
            )

    group = F.when(F.col("page_group").isNotNull(), F.xxhash64("tbl", "page_group")).alias("page_group")
    schema = "tbl string, region_no bigint, page_group bigint, symbols string, keys array<bigint>, broken array<struct<line_no:int,left:string,right:string>>"
    return texts.select("tbl", "region_no", group, "text").mapInArrow(run, schema)


def line_labels(scanned: DataFrame) -> DataFrame:
    """(``tbl``, ``region_no``, ``line_no``, ``kind``) of running heads and page-number lines.

    ``scanned`` is that of ``scan_lines``. A line is a candidate for a head
    where its key is found in another region of the group.
    """
    keyed = scanned.where("page_group is not null").select("region_no", "page_group", F.posexplode("keys").alias("i", "key")).where("key != 0")
    # What recurs is told by key and group; the keys of one head and group meet as one row and are spread again.
    again = keyed.groupBy("page_group", "key").agg(F.min("region_no").alias("a"), F.max("region_no").alias("b")).where("a != b").select("page_group", "key")
    flagged = keyed.join(again.hint("shuffle_hash"), ["page_group", "key"]).groupBy("page_group", "region_no").agg(F.collect_set("i").alias("again"))
    rows = scanned.select("tbl", "region_no", "page_group", "symbols").join(flagged, ["page_group", "region_no"], "left")
    # Only texts with something to label go on.
    rows = rows.where(F.col("again").isNotNull() | F.col("symbols").rlike(f"[{NUMBER}{BARE_NUMBER}]"))

    @F.pandas_udf("seq string, numbers array<int>")
    def mark(symbols: pd.Series, again: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([with_recurring(s, a if a is not None else ()) for s, a in zip(symbols, again)], columns=["seq", "numbers"])

    rows = materialise(rows.withColumn("x", mark("symbols", "again")).select("tbl", "region_no", "x.numbers", "x.seq"))
    model = fit_lines(materialise(rows.groupBy("seq").agg(F.count("*").alias("n"))))
    move, emit = model.move, model.emit

    @F.pandas_udf("array<struct<line_no:int,kind:string>>")
    def label(seq: pd.Series, numbers: pd.Series) -> pd.Series:
        m = LineModel()
        m.move, m.emit = move, emit
        path = lru_cache(100_000)(m.path)
        return pd.Series([[{"line_no": int(n), "kind": FURNITURE[s]} for s, n in zip(path(q), ns) if s in FURNITURE] for q, ns in zip(seq, numbers)])

    return rows.select("tbl", "region_no", F.explode(label("seq", "numbers")).alias("x")).select("tbl", "region_no", "x.line_no", "x.kind").distinct()


def _tokens(column: Column) -> Column:
    return F.split(column, r"[ \n\t\r\f ]+")


def word_counts(texts: DataFrame) -> DataFrame:
    """(``token``, ``n``, ``w``) of all different white-space-separated tokens as they stand, with the bare word in lower case."""
    each = texts.select(F.explode(_tokens(F.col("text"))).alias("token")).where("token != ''").groupBy("token").agg(F.count("*").alias("n"))
    return each.withColumn("w", F.lower(F.btrim("token", F.lit(ADJOINING))))


def bare_word(token: str) -> str:
    return token.strip(ADJOINING)


def intended(word: str) -> list[str]:
    """The words that one confusion, or the same one twice, may have turned into ``word``."""
    out = {}
    for right, read in CONFUSIONS:
        start = word.find(read)
        if start < 0:
            continue
        places = []
        while start >= 0:
            places.append(start)
            start = word.find(read, start + 1)
        for p in places:
            out[word[:p] + right + word[p + len(read) :]] = None
        if len(places) > 1:
            out[word.replace(read, right)] = None
    return [w for w in out if w and w != word]


def _like(word: str, pattern: str) -> str:
    """``word`` with the capitals of ``pattern``."""
    if pattern.isupper() and len(pattern) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def corrections(counts: DataFrame) -> DataFrame:
    """(``token``, ``right``, ``word``) of the tokens that hold a misread word; ``word`` is it repaired, ``right`` the token.

    Words with look-alike characters of other scripts are no misreadings.
    """

    words = counts.where("length(w) > 2")
    usual = words.groupBy("w").agg(F.sum("n").alias("n"))

    @F.pandas_udf("array<string>")
    def sources(s: pd.Series) -> pd.Series:
        run = transducer()

        def one(w: str) -> list[str]:
            letters = sum(c.isalpha() for c in w)
            if letters < 2 or letters < len(w) - 4 or "." in w or "(" in w or not w.isascii() and run(w) != w:
                return []
            return intended(w)

        return pd.Series([one(w) for w in s])

    rare = usual.withColumn("v", F.explode(sources("w")))
    found = rare.join(usual.where(F.col("n") >= LEAST_COUNT).select(F.col("w").alias("v"), F.col("n").alias("nv")), "v").where(F.col("nv") >= RARER * F.col("n"))
    best = found.groupBy("w").agg(F.max(F.struct("nv", "v")).alias("b")).select("w", F.col("b.v").alias("v"))

    @F.pandas_udf("right string, word string")
    def dressed(token: pd.Series, v: pd.Series) -> pd.DataFrame:
        rows = []
        for t, right in zip(token, v):
            bare = bare_word(t)
            at = t.find(bare)
            word = _like(right, bare)
            rows.append((t[:at] + word + t[at + len(bare) :], word))
        return pd.DataFrame(rows, columns=["right", "word"])

    out = words.join(best, "w").withColumn("d", dressed("token", "v"))
    return out.select("token", "d.right", "d.word")


def _rejoined(broken: DataFrame, counts: DataFrame) -> DataFrame:
    """(tbl, region_no, line_no, kind, word): the whole word, its own hyphen kept where that spelling is the more usual."""
    parts = broken.select("left", "right").distinct()
    plain = F.lower(F.concat("left", "right"))
    hyphened = F.lower(F.concat_ws("-", "left", "right"))

    usual = materialise(counts.groupBy("w").agg(F.sum("n").alias("n")))

    @F.pandas_udf("array<string>")
    def sources(s: pd.Series) -> pd.Series:
        return pd.Series([intended(w) for w in s])

    x = parts.withColumn("p", plain).withColumn("h", hyphened)
    x = x.join(usual.select(F.col("w").alias("p"), F.col("n").alias("np")), "p", "left").join(usual.select(F.col("w").alias("h"), F.col("n").alias("nh")), "h", "left").fillna(0, ["np", "nh"])
    unknown = x.where("np < 5 and nh < 5").select("p", "np").distinct().withColumn("v", F.explode(sources("p")))
    mended = unknown.join(usual.where(f"n >= {LEAST_COUNT}").select(F.col("w").alias("v"), F.col("n").alias("nv")), "v").where(f"nv >= {RARER} * np").groupBy("p").agg(F.max(F.struct("nv", "v")).alias("b")).select("p", F.col("b.v").alias("v"))
    x = x.join(mended, "p", "left")

    @F.pandas_udf("string")
    def whole(left: pd.Series, right: pd.Series, np_: pd.Series, nh: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for a, b, p, h, mend in zip(left, right, np_, nh, v):
            if h > p or (p == 0 and a[:1].isupper() and b[:1].isupper() and not a.isupper()):
                out.append(f"{a}-{b}")
            elif isinstance(mend, str):
                out.append(_like(mend, a + b))
            else:
                out.append(a + b)
        return pd.Series(out)

    words = x.select("left", "right", whole("left", "right", "np", "nh", "v").alias("word"))
    return broken.join(words, ["left", "right"]).select("tbl", "region_no", "line_no", F.lit("hyphen").alias("kind"), "word")


def find_noise(texts: DataFrame) -> DataFrame:
    """(``tbl``, ``region_no``, ``line_no``, ``kind``, ``word``) of all noise found.

    ``texts`` has tbl, region_no, page_group (what pages belong together; null:
    none) and text. Null and empty texts have no noise; repeated rows count
    once. Lines are counted from 1, split at line feeds. Kinds: header,
    page_number, hyphen (word broken at the end of the line), char (misread
    word, once a line). All counts are over all texts given.
    """
    texts = texts.where("text is not null and text != ''")
    scanned = materialise(scan_lines(texts))
    labels = materialise(line_labels(scanned))
    counts = materialise(word_counts(texts))
    # A word whose end stands at the end of a line is told from what follows, not from the broken pieces.
    fixes = materialise(corrections(counts))
    if fixes.count() <= MAX_BROADCAST_ROWS:
        fixes = F.broadcast(fixes)
    broken = materialise(scanned.where("size(broken) > 0").select("tbl", "region_no", F.explode("broken").alias("x")).select("tbl", "region_no", "x.*").distinct())
    hyphens = materialise(_rejoined(broken, counts))

    lines = texts.select("tbl", "region_no", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    tokens = lines.select("tbl", "region_no", (F.col("i") + 1).alias("line_no"), _tokens(F.col("line")).alias("t"))
    each = tokens.select("tbl", "region_no", "line_no", F.size("t").alias("k"), F.posexplode("t").alias("j", "token"))
    hits = each.join(fixes, "token").select("tbl", "region_no", "line_no", "j", "k", "word")
    ends = hyphens.select("tbl", "region_no", "line_no", F.lit(True).alias("_end"))
    starts = hyphens.select("tbl", "region_no", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("_start"))
    keys = ["tbl", "region_no", "line_no"]
    chars = hits.join(ends, keys, "left").join(starts, keys, "left").where("not (_end is not null and j >= k - 2 and word is not null and j = k - 1) and not (_start is not null and j = 0)")
    chars = chars.select(*keys, F.lit("char").alias("kind"), "word").distinct().join(labels, keys, "left_anti")
    furniture = labels.select(*keys, "kind", F.lit("").alias("word"))
    return furniture.unionByName(hyphens.join(labels, keys, "left_anti")).unionByName(chars)


def repaired_text(text: str, noise: dict[int, list[tuple[str, str]]]) -> str:
    """``text`` in paragraphs: lines of furniture dropped, broken words joined, misread words put right."""
    out, paragraph, carried = [], [], None
    for i, line in enumerate(text.split("\n"), 1):
        found = noise.get(i, ())
        if any(kind in ("header", "page_number") for kind, _ in found):
            continue
        words = line.split()
        if carried is not None and words:
            bare = words[0].rstrip(ADJOINING)
            words[0] = carried + words[0][len(bare) :]
            carried = None
        if not words:
            if paragraph:
                out.append(" ".join(paragraph))
                paragraph = []
            continue
        fixes = [w for kind, w in found if kind == "char"]
        for w in fixes:
            for k, token in enumerate(words):
                bare = bare_word(token)
                if bare != w and w.lower() in intended(bare.lower()):
                    words[k] = token.replace(bare, w)
        broken = [w for kind, w in found if kind == "hyphen"]
        if broken:
            last = words.pop()
            head = last[: len(last) - len(last.lstrip(ADJOINING))]
            carried = head + broken[0]
        paragraph += words
    if carried is not None:
        paragraph.append(carried)
    if paragraph:
        out.append(" ".join(paragraph))
    return "\n\n".join(out)


def repair_texts(texts: DataFrame) -> DataFrame:
    """(``tbl``, ``region_no``, ``text``, ``repaired``): continuous paragraphs without the noise of ``find_noise``.

    Null and empty texts come out as they are; repeated rows come out once.
    """
    noise = find_noise(texts).groupBy("tbl", "region_no").agg(F.collect_list(F.struct("line_no", "kind", "word")).alias("noise"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, noise: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, noise):
            by_line = defaultdict(list)
            for x in found if found is not None else ():
                by_line[x["line_no"]].append((x["kind"], x["word"]))
            out.append(t if not t else repaired_text(t, by_line))
        return pd.Series(out)

    rows = texts.select("tbl", "region_no", "text").distinct().join(noise, ["tbl", "region_no"], "left")
    return rows.select("tbl", "region_no", "text", mend("text", "noise").alias("repaired"))
