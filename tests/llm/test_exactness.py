"""Joins against brute force, planted cases, and inputs beyond former bounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import names
from scanloom.llm import near_duplicates as nd
from scanloom.llm.canonical import Transducer, look_same_pairs, mapping
from scanloom.llm.mixing import entropy, plan_mix, plan_temperature
from scanloom.llm.personal_data import NAME_WORDS, propose
from scanloom.llm.pieces import split_oversized
from scanloom.llm.reference_match import MAX_DISTANCE, MIN_LETTERS, character_pairs, distances, edits_of, least_shared, map_to_reference, name_form
from scanloom.llm.scan_repair import GAP, LineModel, broken_ends, find_noise, fit_lines, head_key, line_symbols, with_recurring


def slip(word: str) -> str:
    i = random.randrange(len(word))
    how = random.randrange(4)
    if how == 0:
        return word[:i] + word[i + 1 :]
    if how == 1:
        return word[:i] + random.choice("abc") + word[i:]
    if how == 2:
        return word[:i] + random.choice("abc") + word[i + 1 :]
    return word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]


# --- names -----------------------------------------------------------------


@pytest.mark.parametrize("trie_words", [5000, 7])
def test_shards_lose_no_pair_a_single_edit_apart(spark, monkeypatch, trie_words):
    monkeypatch.setattr(names, "TRIE_WORDS", trie_words)
    random.seed(11)
    words = {"smith", "smyth", "taylor", "talyor", "ali", "ani", "omar", "oamr", "ab", "ba", "a"}
    for n in range(3, 13):
        for _ in range(25):
            w = "".join(random.choice("abc") for _ in range(n))
            words |= {w, slip(w)}
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([("g", w, len(w)) for w in words], "grp string, w string, n bigint")
    got = {(r["w"], r["near"]) for r in names._near_in_shards(df, ["grp"], "w", "n").collect()}
    pairs = [(a, b) for a in words for b in words if a != b]
    assert got == {p for p, d in zip(pairs, edits_of(*zip(*pairs))) if d <= 1}


def test_planted_spellings_are_found(spark):
    random.seed(12)
    letters = lambda n: "".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(n)).title()
    firsts = ["Robert", "Clara", "Peter", "Hugo", "Martha", "Simon"]
    rows, expected = [], set()
    for _ in range(40):
        family, given, middle = letters(4), random.choice(firsts), random.choice(firsts)
        forms = [f"{given} {middle} {family}", f"{family}, {given} {middle}", f"Dr. {given} {family}", f"{given} {middle[0]}. {family}", f"{given} {family.upper()}", f"{given} {middle} {family[:3]}{family[4:]}"]
        rows += forms
        expected |= {tuple(sorted((a, b))) for a in forms for b in forms if a != b}
    df = spark.createDataFrame([(n,) for n in rows], "patient_name string")
    short = spark.createDataFrame([], "formal string, short_form string, lang string")
    got = {(r["name_a"], r["name_b"]) for r in names.same_person_pairs(df, ["patient_name"], short).collect()}
    assert len(got & expected) >= 0.9 * len(expected) and len(got & expected) >= 0.9 * len(got)


# --- reference list ----------------------------------------------------------


def test_edits_of_many_pairs():
    random.seed(3)
    a = ["".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in range(300)]
    b = [slip(slip(x)) if len(x) > 2 else "ab" for x in a]

    def osa(x, y):
        d = {(i, -1): i + 1 for i in range(-1, len(x))} | {(-1, j): j + 1 for j in range(-1, len(y))}
        for i in range(len(x)):
            for j in range(len(y)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i] != y[j]))
                if i and j and x[i] == y[j - 1] and x[i - 1] == y[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x) - 1, len(y) - 1]

    assert edits_of(a, b).tolist() == [osa(x, y) for x, y in zip(a, b)]


def test_no_entry_within_the_edits_is_lost(spark):
    random.seed(13)
    entries = sorted({"".join(random.choice("abcdefgh") for _ in range(random.randint(4, 14))) for _ in range(60)} | {"abcdefgh", "abababab"})
    values = ["bacdefhg", "babababa"] + [slip(slip(random.choice(entries))) + random.choice(["", "", "."]) for _ in range(250)] + ["".join(random.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    ref = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "t int, s string")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "item bigint, v string")
    got = {r["item"]: r["t"] for r in map_to_reference(df, "item", "v", ref, "t", "s").collect()}
    forms = {name_form(e)[0]: i for i, e in reversed(list(enumerate(entries)))}
    for i, v in enumerate(values):
        form, short = name_form(v)
        d = {forms[e]: x for e, x in zip(forms, distances([form] * len(forms), [short] * len(forms), list(forms))) if x <= MAX_DISTANCE and (len(form) >= MIN_LETTERS or x == 0)}
        assert (got[i] == -1) if not d else d.get(got[i]) == min(d.values()), (v, got[i], d)


def test_pairs_are_numbered_and_bounds_hold(spark):
    tokens = spark.createDataFrame([("anan", False)], "f string, s boolean").select(character_pairs(F.col("f"), F.col("s")).alias("t")).first()["t"]
    assert tokens == ["^a0", "an0", "na0", "an1", "n$0"]
    assert least_shared(8, False, 0.27) == 3 and all(least_shared(n, False, 0.27) >= 0 for n in range(200))


# --- scan noise --------------------------------------------------------------


def test_furniture_of_any_depth_and_pages_within_a_text(spark):
    body = [f"the patient felt {w} and then rested until noon today" for w in "fine well weak tired".split()]
    head = ["Hill Clinic form nine", "Department of Surgery north", "Confidential record copy", "Second floor desk east"]
    long = "Hill Clinic " + "of the northern and the southern valley " * 5 + "unit"
    rows = [("t", p, "s", "\n".join([*head, long, body[p], "plain words " + "xyz"[p] + " follow here", "", f"{p + 1}"])) for p in range(3)]
    rows += [("t", 50, "u", f"Ward seven list\n{body[0]}\nan own line\nPage 1\n\fWard seven list\n{body[1]}\nanother line\nPage 2"), ("t", 51, "u", f"Ward seven list\n{body[2]}\nfurther words\nPage 3")]
    rows += [("t", 100 + i, None, f"{body[i % 4]}\nwords number {i} alone") for i in range(60)]
    df = spark.createDataFrame(rows, "tbl string, region_no bigint, page_group string, text string")
    got = {(r["region_no"], r["line_no"], r["kind"]) for r in find_noise(df).where("word = ''").collect()}
    assert got >= {(p, k, "header") for p in range(3) for k in range(1, 6)} | {(p, 9, "page_number") for p in range(3)}
    assert got >= {(50, 1, "header"), (50, 4, "page_number"), (50, 5, "header"), (50, 8, "page_number")}


def test_symbols_of_all_lines():
    symbols, keys = line_symbols("Hill Clinic form\nHe slept.\nmore plain words\n\nlast plain words\n- 4 -")
    assert symbols == "tstt_tn"[:1] + "st_tn" and keys[0] == head_key("Hill Clinic form")
    assert with_recurring(symbols, [0]) == ("h" + GAP + "n", [1, 0, 6])
    assert len(LineModel().path("t" * 30_000)) == 30_000


def test_the_fit_is_that_of_all_sequences(spark):
    counts = {"h~n": 30, "~": 500, "h~": 20, "~b": 9, "ht_tn": 1}
    one = LineModel().fit(counts)
    many = fit_lines(spark.createDataFrame(list(counts.items()), "seq string, n bigint").repartition(4))
    assert all(one.move[a][b] == pytest.approx(many.move[a][b]) for a in one.move for b in one.move[a])


def test_broken_words_of_any_length():
    assert broken_ends("a long transp- \n  orted, home") == [(1, "transp", "orted")] and broken_ends("x-\n\ny") == []
    assert broken_ends("a" * 200_000 + "-\nb") == [(1, "a" * 200_000, "b")]


# --- near duplicates -----------------------------------------------------------


@pytest.mark.parametrize("words, threshold", [(1, 0.5), (2, 0.3), (3, 0.9)])
def test_other_thresholds_and_small_sets(spark, monkeypatch, words, threshold):
    monkeypatch.setattr(nd, "COLOURS", 2)
    random.seed(21)
    texts = {k: " ".join(random.choice("abcdef") for _ in range(random.randint(0, 9))) for k in range(120)}
    df = spark.createDataFrame([(k, t, None, None) for k, t in texts.items()], "l bigint, lt string, r bigint, rt string")
    got = {(r["record_a"], r["record_b"]) for r in nd.record_pairs(nd.find_near_duplicates(df, [("l", "lt"), ("r", "rt")], threshold, words, 5)).collect()}
    sets = {k: {tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for k, t in texts.items()}
    sets = {k: s for k, s in sets.items() if s}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


# --- personal data ---------------------------------------------------------------


def test_spans_of_any_length_are_proposed():
    local = "a.b" * 60
    text = f"write to {local}@mail.org now. Dr. Anna Maria Luisa Clara Gomez Perez came. قال السيد عبد الرحمن خالد سعيد ناصر حمد نعم"
    found = {(text[a:b], k) for a, b, k in propose(text)}
    assert (f"{local}@mail.org", "email") in found and ("Anna Maria Luisa Clara Gomez Perez", "name") in found
    assert ("عبد الرحمن خالد سعيد ناصر", "name") in found and NAME_WORDS >= 6


# --- canonical forms ---------------------------------------------------------------


def test_longest_match_and_marks_in_any_order():
    t = Transducer()
    assert t.longest("a\u0323\u0302x", 0) == (3, "\u1ead") and t.longest("xa", 0) == (0, None)
    assert len({t(s) for s in ("a\u0323\u0301", "a\u0301\u0323", "\u00e1\u0323", "\u1ea1\u0301", "\u0430\u0301\u0323")}) == 1
    assert t("Ά") == t("Á") and t("a\U000e0100b\U000e0041") == "ab" and t("각") == t("각")
    assert any(len(s) > 1 for s in mapping())


def test_fields_of_one_table_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "heel", None, "x"), (2, "hееl", "heel", "x"), (3, None, "ｈeel", "x")], "k bigint, a string, b string, form string")
    got = {tuple(r) for r in look_same_pairs(df, "k", "a", "b").collect()}
    assert got == {("a", 1, 2), ("b", 2, 3)}


# --- mixing, pieces ------------------------------------------------------------------


def test_temperature_meets_the_entropy_or_stops_at_the_limit():
    rows = [("a", 0.5, 99, 9000), ("b", 0.3, 99, 900), ("c", 0.2, 99, 100)]
    shares = [p.share for p in plan_temperature(rows)]
    assert entropy(shares) == pytest.approx(entropy([0.5, 0.3, 0.2]), abs=1e-6) and shares[0] > shares[1] > shares[2]
    capped = plan_temperature([(s, w, 1, n) for s, w, _, n in rows])
    assert all(p.tokens >= p.passes * p.tokens + p.rest for p in capped)
    assert plan_temperature([]) == [] and plan_temperature([("x", 0.0, 1, 5)])[0].rest == 0


def test_default_plan_meets_the_weights():
    plans = plan_mix([("a", 0.5, 2, 1000), ("b", 0.5, 1, 300)])
    assert [p.share for p in plans] == [0.5, 0.5] and sum(p.passes * p.tokens + p.rest for p in plans) == 600


def test_wide_overlaps_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "k")], "doc_id bigint, text string, kind string")
    with pytest.raises(ValueError, match="overlap"):
        split_oversized(docs, spark.createDataFrame([("k", 10, 6)], "kind string, max_tokens int, overlap_tokens int"))
