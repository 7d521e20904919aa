"""Personal values in free text, found and replaced by typed placeholders.

Generators of high recall propose spans, which may overlap; boosted trees judge
each by its form and by the words around it; of overlapping spans above their
type's threshold the likeliest stays. The trees are fitted on a bounded sample
of the texts, labelled where form and wording leave no doubt; the doubtful rest
is left to the trees.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.boosting import BoostedTrees

TYPES = ("email", "phone", "id_number", "address", "name")

#: Texts that the trees are fitted on, at most, and most usual words that are known to the features.
FIT_TEXTS, KNOWN_WORDS = 8_000, 20_000
#: Words of a name, at most.
NAME_WORDS = 7

# Words that come before or after personal values and others.
PHONE_CUES = frozenset("mobile ring call on from phone tel telephone fax الجوال للاستفسار هاتف الرقم موبايل".split())
ID_CUES = frozenset("id card ssn file passport الهوية الملف هوية".split())
OTHER_NUMBER_CUES = frozenset("no number tube sample batch accession form file order firmware printed expired doses ran reading version العينة النموذج رقم قراءة الضغط القسم lot ref".split())
NAME_CUES = frozenset("dr doctor nurse daughter son wife husband mother father sister brother carer is to by mr mrs ms prof signed التوقيع السيدة السيد الدكتور الدكتورة قريبه قريبته باسم الممرض".split())
TITLE_WORDS = frozenset("dr doctor nurse mr mrs ms miss prof professor السيدة السيد الدكتور الدكتورة".split())
NAME_FOLLOWERS = frozenset("phoned asked left reachable in هاتف من بعد rang called".split())
STREETS = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Drive|Dr|Way|Court|Square|Terrace|Place|Row|Crescent|Boulevard|Blvd)"
FLATS = r"(?:Flat|Apt|Apartment|Unit|Suite)"
ARABIC_STREETS = r"(?:شارع|طريق|زقاق|جادة|درب|ميدان|شقة)"

_BREAK = r"(?:[-­¬‐]\s*\n\s*[a-z]+)?"
_CAP = rf"[A-Z{''.join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)}]"
# Patterns begin with a plain character or digit, so that the scan skips to it; what may stand before is looked up afterwards.
_AT = re.compile(r"@|\(at\)|\[at\]", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"\s?[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*")
_DIGITS = re.compile(r"\d(?:[\d/]|[-.](?=\d)|\)\s?|[ \n](?=[\d(]))*\d(?:\s*ext\.?\s*\d{1,5})?(?![\w/])")
_NUMBER_HEAD = re.compile(r"(?:[A-Z]{1,4}[-/]?|[+(])\Z")
_WESTERN = re.compile(rf"\d{{1,4}}[A-Z]?\s+(?:{_CAP}\w+{_BREAK}\s+){{1,3}}{STREETS}\b\.?(?:,\s+{FLATS}\s+\d+[A-Z]?)?(?:,\s+{_CAP}\w+{_BREAK}(?:\s+\d{{5}}\b)?)?")
_FLAT_HEAD = re.compile(rf"{FLATS}\s+\d+[A-Z]?,\s+\Z")
_ARABIC = re.compile(rf"{ARABIC_STREETS}\s+(?:[ء-ي1]+\s+){{1,3}}\d{{1,4}}،\s+(?:(?:ال)?حي\s+)?[ء-ي1]+،\s+[ء-ي1]+")
_CAPITALS = re.compile(rf"(?:{_CAP}\.|{_CAP}[\w@|]+{_BREAK})(?:,?\s+(?:{_CAP}\.|{_CAP}[\w@|]+{_BREAK}))+(?![\w@])")
_CAPITAL = re.compile(rf"{_CAP}\.|{_CAP}[\w@|]+{_BREAK}")
_ARABIC_CUE = re.compile(r"(?:السيدة|السيد|الدكتورة|الدكتور|قريبه|قريبته|باسم|التوقيع:|Signed:|Dr\.|Nurse|daughter|son|wife|husband|mother|father|sister|brother|kin\s+is|belongs\s+to)(?![ء-يa-z])\s*(?=[ء-ي])|carer\s+\(\s*(?=[ء-ي])")
_ARABIC_RUN = re.compile(rf"[ء-ي1ـ٥]+(?:\s+[ء-ي1ـ٥]+){{1,{NAME_WORDS}}}")
_CALLED = re.compile(r"phoned|asked\s+for|rang\b|called\b")
_ARABIC_WORD = re.compile(r"[ء-ي1ـ٥]+")
_WORD = re.compile(r"[\w@|]+")


def _local_start(text: str, at: int) -> int | None:
    """Where the part of an address before ``at`` begins, however long it is; None if there is none."""
    end = at - 1 if at and text[at - 1].isspace() else at
    start = end
    while start and text[start - 1] in _LOCAL:
        start -= 1
    while start < end and text[start] in "._%+-":
        start += 1
    return start if start < end else None


def _arabic_before(text: str, at: int, most: int) -> list[tuple[int, int]]:
    """Spans of the up to ``most`` Arabic words that end, with white space, before ``at``."""
    spans: list[tuple[int, int]] = []
    while at and text[at - 1].isspace() and len(spans) < most:
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and _ARABIC_WORD.fullmatch(text[at - 1]):
            at -= 1
        if at == end:
            break
        spans.append((at, end))
    return spans[::-1]


def propose(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every span that may be a personal value."""
    out = []
    for m in _AT.finditer(text):
        start = _local_start(text, m.start())
        right = _DOMAIN.match(text, m.end())
        if start is not None and right:
            out.append((start, right.end(), "email"))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 7 or sum(c.isdigit() for c in m[0]) < 7:
            continue
        head = _NUMBER_HEAD.search(text[max(0, m.start() - 5) : m.start()])
        start = m.start() - len(head[0]) if head else m.start()
        if start and (text[start - 1].isalnum() or text[start - 1] in "/-"):
            continue
        out.append((start, m.end(), "phone"))
        if " " not in m[0] and "\n" not in m[0] and "(" not in m[0]:
            out.append((start, m.end(), "id_number"))
    for m in _WESTERN.finditer(text):
        if m.start() and text[m.start() - 1] in "0123456789/.-":
            continue
        head = _FLAT_HEAD.search(text[max(0, m.start() - 20) : m.start()])
        out.append((m.start() - len(head[0]) if head else m.start(), m.end(), "address"))
    for m in _ARABIC.finditer(text):
        out.append((m.start(), m.end(), "address"))
    for m in _CAPITALS.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.@+-"):
            continue
        spans = [(t.start() + m.start(), t.end() + m.start()) for t in _CAPITAL.finditer(m[0])]
        for i in range(len(spans)):
            for j in range(i + 1, min(i + NAME_WORDS, len(spans))):
                if text[spans[j][0] : spans[j][1]][-1] != ".":
                    out.append((spans[i][0], spans[j][1], "name"))
    for m in _ARABIC_CUE.finditer(text):
        if m.start() and text[m.start() - 1].isalpha():
            continue
        run = _ARABIC_RUN.match(text, m.end())
        if run:
            spans = [t.span() for t in _ARABIC_WORD.finditer(text, run.start(), run.end())]
            out += [(spans[0][0], spans[j][1], "name") for j in range(1, min(NAME_WORDS, len(spans)))]
    for m in _CALLED.finditer(text):
        spans = _arabic_before(text, m.start(), NAME_WORDS)
        out += [(spans[i][0], spans[-1][1], "name") for i in range(len(spans) - 1)]
    return list(dict.fromkeys(out))


def _words_before(text: str, at: int, n: int = 3) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, at - 40) : at])][-n:][::-1]


def _words_after(text: str, at: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[at : at + 30])][:2]


def _sign(word: str) -> float:
    """A stable number for a word, so that trees can split on single frequent words through several of them."""
    return (zlib.crc32(word.encode()) % 4093) / 4093 if word else -1.0


def describe(text: str, start: int, end: int, kind: str, known: frozenset[str]) -> list[float]:
    """Features of a span: its form, its words, what surrounds it."""
    s = text[start:end]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"\d+", s)
    words = _WORD.findall(s)
    usual = [w.lower() in known for w in words]
    before, after = _words_before(text, start), _words_after(text, end)
    near = set(before)
    prior = text[start - 1] if start else "\n"
    follow = text[end] if end < len(text) else "\n"
    gap = text[max(0, start - 3) : start]
    rest = text[end : end + 3]
    return [
        len(s), len(words), len(digits), len(groups), *(len(groups[k]) if k < len(groups) else 0 for k in range(4)),
        s.count("-"), s.count("."), s.count("/"), s.count(","), "+" in s, "(" in s, s.startswith("00"), "ext" in s, any("٠" <= c <= "٩" for c in s), "@" in s or "at" in s,
        sum(c.isupper() for c in s), s[:1].isupper(), s[:3] == "MRN", s[:3] == "NID", s[:1] == "P" and s[1:2].isdigit(), s[:2] in ("05", "٠٥", "55", "+9", "00", "(5"),
        bool(near & PHONE_CUES), bool(set(before[:2]) & ID_CUES), bool(set(before[:2]) & OTHER_NUMBER_CUES), bool(set(before[:1]) & NAME_CUES), bool(set(after[:1]) & NAME_FOLLOWERS),
        before[0] in known if before else False, after[0] in known if after else True, _sign(before[0] if before else ""), _sign(after[0] if after else ""),
        sum(usual), bool(usual and usual[0]), bool(usual and usual[-1]), bool(words and words[0].lower() in TITLE_WORDS),
        prior in ".:\n", prior == " " and gap[-2:-1] in ".:؟!", prior == "(", follow in ".,;،)\n", follow == ":", rest[:2] == ", ", len(words[-1]) if words else 0, len(words[0]) if words else 0,
        bool(re.search(r"[a-z][A-Z]|[A-Z]{3}", s)), ("\n" in s),
        bool(re.search(r"\.[A-Za-z]{2,}$", s)) if kind == "email" else bool(re.search(r"\d{5}$", s)),
    ]


_PHONE_FORM = re.compile(r"(?:\+\d{3}[\s.\-]?\d{2}[\s.\-]?\d{3}[\s.\-]?\d{4}|00\d{3}-\d{2}-\d{3}-\d{4}|[0٠]\d{3}[\s.\-]\d{3}[\s.\-]\d{4}|\d{3}[\s.\-]\d{3,4}[\s.\-]\d{4}|\(\d{3}\)\s?\d{3}-\d{4})(?:\s*ext\.?\s*\d+)?")
_ID_FORM = re.compile(r"MRN-?\d{4}-?\d{3,6}|NID/\d+/\d+|[A-Z]\d{8}|\d{14}|\d{3}-\d{4}-\d{7}-\d|\d{3}-\d{2}-\d{4}|[1١]\d{9}")


def sure(text: str, start: int, end: int, kind: str, known: frozenset[str]) -> int | None:
    """1 or 0 where the form and the words around a span leave no doubt, else None."""
    s = text[start:end]
    before, after = _words_before(text, start), _words_after(text, end)
    if kind == "email":
        local = re.split(r"\s?(?:@|\(at\)|\[at\])\s?", s, flags=re.I)
        return int(len(local) == 2 and "." in local[1] and len(local[0]) > 2)
    if kind == "phone":
        if not _PHONE_FORM.fullmatch(s):
            return 0
        return 1 if set(before) & PHONE_CUES and not set(before[:1]) & OTHER_NUMBER_CUES else 0 if set(before[:2]) & (OTHER_NUMBER_CUES | ID_CUES) else None
    if kind == "id_number":
        if not _ID_FORM.fullmatch(s):
            return 0
        return 1 if set(before[:2]) & ID_CUES else 0 if set(before[:1]) & (OTHER_NUMBER_CUES | PHONE_CUES) else None
    if kind == "address":
        if re.match(ARABIC_STREETS, s):
            return 1
        return 1 if re.search(rf",\s+{_CAP}\w+(?:\s+\d{{5}})?$", s) and not re.search(rf",\s+{FLATS}$", s) else 0
    words = _WORD.findall(s)
    lows = [w.lower() for w in words]
    rare = [w not in known and len(w) > 3 for w in lows]
    if any(w in TITLE_WORDS for w in lows) or not any(rare):
        return 0
    arabic = "ء" <= s[0] <= "ي"
    if arabic:
        joined = "عبد" in lows[:-1]
        if not rare[-1] or not 2 <= len(words) <= 3 + joined or sum(rare) > 1 or "،" in s:
            return 0
        if after and after[0] not in known and text[end : end + 1] in " \n":
            return 0
        return 1 if before and (before[0] in NAME_CUES or (after and after[0] in NAME_FOLLOWERS)) else None
    run_on = re.match(rf",?\s+(?:{_CAP}\.|{_CAP}\w+)", text[end:]) and not re.match(r"[.]", text[end:])
    led = re.search(rf"(?:{_CAP}\.|{_CAP}\w+),?\s+$", text[:start][-30:]) and not (before and before[0] in TITLE_WORDS)
    if (before and before[0] in NAME_CUES) or (after and after[0] in NAME_FOLLOWERS):
        if run_on and rare[-1] is False:
            return 0
        if led and not re.search(r"[.:]\s+$", text[:start][-3:]):
            return 0
        return int(rare[-1] or rare[0])
    return 0


class Finder:
    """Fitted trees for each type, and the words they know."""

    def __init__(self, known: frozenset[str], trees: dict[str, BoostedTrees]) -> None:
        self.known, self.trees = known, trees

    @classmethod
    def fit(cls, texts: list[str], known: frozenset[str]) -> Finder:
        """Trees on the spans without doubt of ``texts``; every fifth text only sets the thresholds."""
        rows: dict[str, list] = {k: [] for k in TYPES}
        for i, text in enumerate(texts):
            for start, end, kind in propose(text):
                y = sure(text, start, end, kind, known)
                if y is not None:
                    rows[kind].append((i % 5 == 0, y, describe(text, start, end, kind, known)))
        trees = {}
        for kind, found in rows.items():
            width = len(describe("a", 0, 1, kind, known))
            x = np.array([f for *_, f in found], float).reshape(-1, width)
            y = np.array([v for _, v, _ in found], float)
            held = np.array([h for h, *_ in found], bool)
            trees[kind] = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        return cls(known, trees)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The spans of each text, in order, none overlapping another."""
        spans: list[tuple[int, int, int, str]] = []
        features: dict[str, list] = {k: [] for k in TYPES}
        at: dict[str, list[int]] = {k: [] for k in TYPES}
        for i, text in enumerate(texts):
            for start, end, kind in propose(text):
                at[kind].append(len(spans))
                spans.append((i, start, end, kind))
                features[kind].append(describe(text, start, end, kind, self.known))
        p = np.zeros(len(spans))
        for kind in TYPES:
            if at[kind]:
                q = self.trees[kind].probability(np.array(features[kind], float))
                p[at[kind]] = np.where(q >= self.trees[kind].threshold, q, 0)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        taken: list[list[tuple[int, int]]] = [[] for _ in texts]
        ranked = sorted(np.flatnonzero(p > 0), key=lambda k: (-round(p[k], 3), spans[k][1] - spans[k][2], spans[k][1]))
        for k in ranked:
            i, start, end, kind = spans[k]
            if all(end <= a or start >= b for a, b in taken[i]):
                taken[i].append((start, end))
                out[i].append((start, end, kind))
        return [sorted(x) for x in out]


def known_words(texts: DataFrame, most: int = KNOWN_WORDS) -> frozenset[str]:
    """The ``most`` usual words of all texts that stand once in 5 000 texts or more often, and three times at least."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[\s.,;:،؛؟!()\[\]\"«»]+")).alias("w")).where("length(w) > 1")
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    total = texts.count()
    rows = counts.where(F.col("n") >= max(3, total / 5_000)).orderBy(F.desc("n"), "w").limit(most).collect()
    return frozenset(r["w"] for r in rows)


def fitted_finder(texts: DataFrame, fit_texts: int = FIT_TEXTS) -> Finder:
    """A finder fitted on at most ``fit_texts`` texts, those of the smallest hash among texts that may hold something."""
    known = known_words(texts)
    some = texts.where(F.col("text").rlike(r"[@\d]|باسم|قريب|السيد|الدكتور|Nurse|phoned|carer"))
    # Rows of small hash values are cut out first, so that little more than the sample itself is gathered.
    share = min(1.0, 1.5 * fit_texts / max(1, some.count()))
    hashed = some.select("text", F.xxhash64("text").alias("h")).where(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    sample = hashed.orderBy("h", "text").limit(fit_texts).select("text").collect()
    return Finder.fit([r["text"] for r in sample], known)


def find_personal_data(texts: DataFrame, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """(``tbl``, ``region_no``, ``pii_type``, ``pii_text``) of the personal values of (tbl, region_no, text) rows.

    ``pii_text`` is what stands in the text. Types: email, phone, id_number,
    address, name. Null and empty texts hold nothing; repeated rows count once.
    The trees, a few kilobytes, and at most ``KNOWN_WORDS`` words go to every task.
    """
    texts = texts.select("tbl", "region_no", "text").where("text is not null and text != ''")
    shared = texts.sparkSession.sparkContext.broadcast(fitted_finder(texts, fit_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            row, kinds, out = [], [], []
            for k, spans in enumerate(shared.value.find(values)):
                for start, end, kind in spans:
                    row.append(k)
                    kinds.append(kind)
                    out.append(values[k][start:end])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=["tbl", "region_no", "pii_type", "pii_text"])

    return texts.mapInArrow(run, "tbl string, region_no bigint, pii_type string, pii_text string").distinct()


def mask_personal_data(texts: DataFrame, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """(``tbl``, ``region_no``, ``text``, ``masked``): each personal value replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    The rest of the text is unchanged; null and empty texts come out as they are. Rows are not deduplicated.
    """
    shared = texts.sparkSession.sparkContext.broadcast(fitted_finder(texts.where("text is not null and text != ''"), fit_texts))

    @F.pandas_udf("string")
    def mask(s: pd.Series) -> pd.Series:
        values = [t or "" for t in s]
        out = []
        for t, spans, original in zip(values, shared.value.find(values), s):
            if not t:
                out.append(original)
                continue
            parts, last = [], 0
            for start, end, kind in spans:
                parts += [t[last:start], f"[{kind.upper()}]"]
                last = end
            out.append("".join([*parts, t[last:]]))
        return pd.Series(out)

    return texts.select("tbl", "region_no", "text", mask("text").alias("masked"))
