from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import near_duplicates as nd
from scanloom.llm.boosting import BoostedTrees
from scanloom.llm.bpe import CorpusEncoder, MergeTransducer, StreamDecoder, load_ranks, tokenizer_path
from scanloom.llm.canonical import ConflictError, Transducer, look_same_pairs, mapping, with_canonical
from scanloom.llm.mixing import bisect_exponent, mix_sources, plan_mix, reached_shares, temperature_shares
from scanloom.llm.names import Trie, parse_name, same_person_pairs
from scanloom.llm.personal_data import TYPES, Finder, find_personal_data, mask_personal_data, propose
from scanloom.llm.pieces import split_oversized
from scanloom.llm.reference_match import edits, jaccard_join, map_to_reference, name_form
from scanloom.llm.scan_repair import CONFUSIONS, LineModel, find_noise, head_key, intended, page_symbol, repair_texts
from scanloom.llm.tokens import count_tokens, decode_column, encode_column

# --- canonical forms -------------------------------------------------------


def test_mapping_is_free_of_conflicts_and_idempotent():
    t = Transducer()
    assert mapping() and all(t(t(c)) == t(c) for c in mapping())
    random.seed(3)
    for _ in range(2000):
        s = "".join(random.choice("aе́éｅﬁ⁠ ۳٤أأ-‐я\nZﷺ각") for _ in range(12))
        assert t(t(s)) == t(s)


@pytest.mark.parametrize("a, b", [("ｈｅｅｌ", "heel"), ("е́", "é"), ("ﬁn", "fin"), ("a b", "a b"), ("a​b", "ab"), ("a‑b", "a-b"), ("ﻷ", "لأ"), ("۳", "٣"), ("أ", "أ"), ("µ", "μ")])
def test_look_alikes_become_one(a, b):
    t = Transducer()
    assert t(a) == t(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("ا", "أ"), ("۴", "٤"), ("٣", "3"), ("a.", "a"), ("–", "-"), ("²", "2")])
def test_visible_differences_stay(a, b):
    t = Transducer()
    assert t(a) != t(b)


def test_conflicting_rules_are_refused(monkeypatch):
    from scanloom.llm import canonical

    monkeypatch.setitem(canonical.LOOK_ALIKES, "Ж", "ｋ")
    monkeypatch.setitem(canonical.LOOK_ALIKES, "ж", "ﬁ")
    assert canonical.mapping.__wrapped__()["ж"] == "fi"
    monkeypatch.setattr(canonical, "_compose", lambda t: t + "x")
    with pytest.raises(ConflictError):
        canonical.mapping.__wrapped__()


def test_look_same_pairs_against_brute_force_with_hot_group(spark):
    base = ["heel", "ｈｅｅｌ", "heеl", "HEEL", "", None, "he​el"]
    rows = [(i, base[i % 7], i) for i in range(60)] + [(3, base[3], 3), (None, "heel", 0)]
    df = spark.createDataFrame(rows, "k bigint, v string, form int")
    from scanloom.llm import canonical
    from scanloom.operators import blocks

    got = {(r["key_a"], r["key_b"]) for r in look_same_pairs(df, "k", "v").collect()}
    t = canonical.transducer()
    some = [(k, v) for k, v, _ in set(rows) if v is not None and k is not None]
    assert got == {(a, b) for a, x in some for b, y in some if a < b and x != y and t(x) == t(y)}
    assert blocks.BLOCK_ROWS > 1 and look_same_pairs(df.limit(0), "k", "v").count() == 0
    assert with_canonical(df, "v").where("k = 5").first()["canonical"] is None


# --- tokens ----------------------------------------------------------------

TEXTS = ["", None, "don't  stop\n\n x's", "ضغط الدم ١٢٠", "<|endoftext|> a", "  ", "½ ² é 🙂" * 50, "x" * 3000, "a\t'll 'S"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(tokenizer_path()), special_tokens={})


def test_encoding_equals_the_public_library(reference):
    enc = CorpusEncoder(tokenizer_path())
    random.seed(1)
    fuzz = ["".join(random.choice("abc's  \n\t're'll'LLdm1٢²½ـ،é́日🙂<|>\x1c\x85 _-.") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts = [t or "" for t in TEXTS] + fuzz
    ids, sizes = enc.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == reference.encode_ordinary(t), t
    assert enc.count(texts).tolist() == sizes.tolist()


def test_transducer_equals_plain_merging():
    t = MergeTransducer(load_ranks(tokenizer_path()))
    random.seed(2)
    for _ in range(300):
        w = "".join(random.choice("etaoin shrdlu") for _ in range(random.randint(1, 25))).encode()
        assert list(t.encode(w)) == t.merge(w)


def test_encode_operator_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    out = encode_column(df, "doc_id", "text")
    rows = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert rows[0] == [] and rows[1] == [] and len(rows) == len(TEXTS)
    back = {r["doc_id"]: r["text"] for r in decode_column(out, "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert [r["n"] for r in count_tokens(df, "text", out="n").orderBy("doc_id").collect()] == [len(rows[i]) for i in range(len(TEXTS))]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_stream_decoder_holds_back_unfinished_characters():
    ranks = load_ranks(tokenizer_path())
    enc = CorpusEncoder(tokenizer_path())
    ids, _ = enc.encode(["🙂 é"])
    d = StreamDecoder(ranks)
    assert "".join(d.feed([i]) for i in ids) + d.close() == "🙂 é"


# --- near duplicates -------------------------------------------------------


def brute_pairs(texts, words, threshold):
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        if s := {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}:
            sets[k] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("cost, block", [(6, 2000), (1e-6, 7), (1e9, 7)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, cost, block):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = {}
    for k in range(0, 60, 3):
        w = [random.choice(vocabulary) for _ in range(random.choice([0, 2, 3, 5, 20, 60]))]
        texts[k], other = " ".join(w), list(w)
        if other:
            other[random.randrange(len(other))] = "edited"
        texts[k + 1], texts[k + 2] = " ".join(other), " ".join(w).upper()
    rows = [(k, t, k + 100, None) for k, t in texts.items()] + [(0, texts[0], 1, texts[1]), (None, "a b c", 2, "")]
    df = spark.createDataFrame(rows, "l bigint, lt string, r bigint, rt string")
    monkeypatch.setattr(nd, "SUBSET_COST", cost)
    found = nd.find_near_duplicates(df, [("l", "lt"), ("r", "rt")], 0.6, 3, block)
    got = {(r["record_a"], r["record_b"]) for r in nd.record_pairs(found, block).collect()}
    expected = brute_pairs(texts, 3, 0.6)
    assert got == expected
    if block == 2000:
        groups = {r["record"]: r["group_id"] for r in nd.record_groups(found).collect()}
        assert all(groups[a] == groups[b] for a, b in expected)


# --- reference list --------------------------------------------------------


def test_forms_and_edits():
    assert name_form("Tab. KIDR0PRYB. 20mg") == name_form("kidropryb.")[:1] + (False,) or name_form("KIDR0PRYB.")[1]
    assert name_form("Finupril196 ml")[0] == name_form("finupril")[0] == name_form(" Fynupril  OD")[0]
    assert edits("abcd", "abdc", 3) == 1 and edits("abc", "xyz", 1) == 2 and edits("", "ab", 5) == 2


def test_jaccard_join_against_brute_force(spark):
    random.seed(5)
    make = lambda n: [(str(i), random.sample("abcdefghij", random.randint(1, 8))) for i in range(n)]
    left, right = make(40), make(40)
    schema = "id string, tokens array<string>"
    got = {(r["l"], r["r"]) for r in jaccard_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.4).collect()}
    assert got == {(a, b) for a, x in left for b, y in right if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.4}


def test_map_to_reference(spark):
    terms = spark.createDataFrame([(1, "Finupril"), (1, "Finupril"), (2, "Zalikifex"), (2, None), (3, " ")], "term_id int, s string")
    values = ["FINUPRIL 5 mg", "zalikifxe", "physiotherapy", None, "  ", "Finup.", "finupril", "finupril"]
    df = spark.createDataFrame([(i, v, 9) for i, v in enumerate(values)], "item_id bigint, medication string, form int")
    got = {r["item_id"]: r["term_id"] for r in map_to_reference(df, "item_id", "medication", terms, "term_id", "s").collect()}
    assert got == {0: 1, 1: 2, 2: -1, 5: 1, 6: 1, 7: 1}


# --- names -----------------------------------------------------------------


def test_trie_against_brute_force():
    random.seed(4)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(120)]
    trie = Trie(words)
    for w in words[:40]:
        for k in (1, 2):
            assert set(trie.near(w, k)) == {v for v in words if edits(w, v, 10) <= k}


def test_parse_name():
    assert parse_name("Dr. WOHBANPAJ, Pete P.") == (["wohbanpaj", "pete", "p"], 1)
    assert parse_name("د. رامي بن خالد هاحبينليط") == (["رامي", "خالد", "هاحبينليط"], 0)
    assert parse_name("عبد الله علي طيد")[0][0] == "عبدالله"
    assert parse_name("n/a") is None and parse_name(" - ") is None and parse_name("غير معروف") is None


def test_same_person_pairs(spark):
    people = ["Robert Paul Wepbeshov", "Clara Ann Wepbeshov", "Peter Hugh Zipgiwvin", "Robert Paul Lumkoflum", "Ann Clara Lumkoflum", "Paul Peter Zipgiwvin"]
    names = people + ["Wepbeshov, Robert Paul", "Dr. Bob Wepbeshov", "ROBERT P. WEPBESHOV", "Robert Paul Wepbshov", "unknown", "", None, "C. Wepbeshov"]
    df = spark.createDataFrame([(n, "x", i) for i, n in enumerate(names * 2)], "patient_name string, name string, family int")
    forms = spark.createDataFrame([("Robert", "Bob", "en")], "formal string, short_form string, lang string")
    got = {(r["name_a"], r["name_b"]) for r in same_person_pairs(df, ["patient_name"], forms).collect()}
    group = [people[0], *names[6:10]]
    expected = {tuple(sorted((a, b))) for a in group for b in group if a != b} | {("C. Wepbeshov", people[1])}
    assert got == expected
    assert same_person_pairs(df.limit(0), ["patient_name"], forms).count() == 0


def test_family_slips_are_linked_whatever_the_counts(spark):
    names = ["Andrew Veklejsop", "Veklejsopp, Andrew", "Robert Wepbeshov", "Bob Wepbshov", "Ann Mary Zipgiwvin", "Ann Clara Zipgiwvan"]
    names += [f"{t} Joseph Vintornec" for t in ("Mr.", "Dr.")] + [f"{t} Joseph Vintorncc" for t in ("Mr.", "Dr.", "Prof.")]
    df = spark.createDataFrame([(n,) for n in names], "patient_name string")
    forms = spark.createDataFrame([("Robert", "Bob", "en")], "formal string, short_form string, lang string")
    got = {(r["name_a"], r["name_b"]) for r in same_person_pairs(df, ["patient_name"], forms).collect()}
    groups = [names[:2], names[2:4], names[6:]]
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}


# --- scan noise ------------------------------------------------------------


def test_line_model_keeps_furniture_at_the_edges():
    m = LineModel()
    assert m.path("ht~tn") == ("top head", "body", "body", "body", "bottom number")
    assert m.path("tnt") == ("body", "body", "body")
    assert head_key("Palmgate  Clinic   7") == head_key("Pa1mgate Clinic") and page_symbol("- 3 -") and page_symbol("33.0") is None


def noise_rows(spark):
    body = ["the patient felt fine today and then", "rested well in the ward until noon", "without any further complaint at all."]
    rows = [("t", 100 + i, None, "\n".join(body)) for i in range(120)]
    for p, how in enumerate(("fine", "well", "weak")):
        rows.append(("t", p, "s", "\n".join([f"Hill {'C1inic' if p else 'Clinic'} form 9", f"the patient felt {how} today and then", f"the pat1ent was {how} and transp-", f"orted home {how} by noon", "", f"Page {p + 1}"])))
    rows += [("t", 200 + i, None, "transported home safely by the crew") for i in range(6)]
    return spark.createDataFrame(rows + [("t", 900, None, None), ("t", 901, None, ""), rows[120]], "tbl string, region_no bigint, page_group string, text string")


def test_noise_is_found_and_repaired(spark):
    df = noise_rows(spark)
    got = {(r["region_no"], r["line_no"], r["kind"], r["word"]) for r in find_noise(df).collect()}
    per_page = lambda p: {(p, 1, "header", ""), (p, 3, "hyphen", "transported"), (p, 3, "char", "patient"), (p, 6, "page_number", "")}
    assert got == per_page(0) | per_page(1) | per_page(2)
    mended = {r["region_no"]: r["repaired"] for r in repair_texts(df).collect()}
    assert mended[0] == "the patient felt fine today and then the patient was fine and transported home fine by noon"
    assert mended[900] is None and mended[901] == ""


def test_every_place_of_a_confusion_is_tried():
    for right, read in CONFUSIONS:
        word = f"{read}~" * 10
        assert f"{read}~" * 9 + f"{right}~" in intended(word) and f"{right}~" * 10 in intended(word)


# --- personal data ---------------------------------------------------------


def test_boosted_trees_learn_a_held_out_rule():
    random.seed(1)
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.6)).astype(float)
    m = BoostedTrees().fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    assert ((m.probability(x[500:]) >= m.threshold) == y[500:]).mean() > 0.95
    assert BoostedTrees().fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((1, 2))).shape == (1,)


def pii_rows():
    random.seed(2)
    rows = []
    for i in range(300):
        phone, ssn = f"0555 0{random.randint(10, 19)} {random.randint(1000, 9999)}", f"9{random.randint(10, 99)}-{random.randint(10, 99)}-{random.randint(1000, 9999)}"
        name = f"{random.choice(['Clara', 'Peter', 'Anton'])} {random.choice('BDFGK')}{random.choice('aeiou')}{random.choice('lmn')}{random.choice('aeiou')}fob{i}".rstrip("0123456789") + "xyz"[i % 3] + "ab"[i % 2] + "mnop"[i % 4]
        text = f"Plan: rest today. Mobile: {phone}. SSN {ssn} copied from the form. Seen by Dr. {name} in the afternoon. Accession 4471-9920 was logged. Reading 120/80 taken. Sample tube {20000 + i}."
        rows.append(("t", i, text, phone, ssn, name))
    return rows


def test_personal_data(spark):
    rows = pii_rows()
    df = spark.createDataFrame([r[:3] for r in rows] + [("t", 998, None), ("t", 999, ""), rows[0][:3]], "tbl string, region_no bigint, text string")
    got = {(r["region_no"], r["pii_type"], r["pii_text"]) for r in find_personal_data(df).collect()}
    expected = {(r[1], k, v) for r in rows for k, v in zip(("phone", "id_number", "name"), r[3:])}
    assert len(got & expected) / len(expected) > 0.95 and len(got & expected) / len(got) > 0.95
    masked = {r["region_no"]: r["masked"] for r in mask_personal_data(df).collect()}
    assert masked[5].startswith("Plan: rest today. Mobile: [PHONE]. SSN [ID_NUMBER] copied") and masked[998] is None and masked[999] == ""


class Certain:
    """Stands for fitted trees: every span is one."""

    threshold = 0.5

    def probability(self, x):
        return np.ones(len(x))


@pytest.mark.parametrize("text", ["التوقيع: أحمد ميعسيتثيق.", "Signed: أحمد ميعسيتثيق", "his wife أحمد ميعسيتثيق", "أحمد ميعسيتثيق rang", "a.b [at] c.org", "Ann Lee"])
def test_no_text_with_a_proposal_is_skipped(text):
    assert propose(text) and Finder(frozenset(), dict.fromkeys(TYPES, Certain())).find([text])[0]


# --- mixing ----------------------------------------------------------------


def test_plan_mix():
    plans = {p.source: p for p in plan_mix([("a", 0.5, 1, 1000), ("b", 0.25, 4, 100), ("c", 0.25, 9, 0), ("d", None, 1, 5)])}
    assert abs(plans["a"].share - 2 / 3) < 1e-9 and plans["c"].passes == 0 == plans["d"].rest
    used = lambda p: p.passes * p.tokens + p.rest
    assert used(plans["b"]) == 400 and used(plans["a"]) == 800
    for total in (10, 500, 1400, 10**9):
        out = plan_mix([("a", 0.5, 1, 1000), ("b", 0.5, 4, 100)], total)
        assert all(used(p) <= p.max_repeats * p.tokens for p in out) and abs(sum(map(used, out)) - min(total, 1400)) <= 1
    assert bisect_exponent(lambda e: e <= 0.25) == pytest.approx(0.25)
    exponent, shares = temperature_shares([900, 100], 0.6, [5, 5], 1000)
    assert 0 < exponent < 1 and -sum(p * np.log(p) for p in shares) == pytest.approx(0.6, abs=1e-6)


def test_mix_sources(spark):
    docs = [(i, "ab"[i % 2] if i % 5 else None, "word " * (1 + i % 7), 1) for i in range(400)] + [(900, "a", None, 1), (901, "a", "", 1), (902, "z", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copy int")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.5, 2), ("none", 0.25, 3)], "source string, weight double, max_repeats int")
    mix = mix_sources(df, targets).cache()
    assert mix.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    shares = {r["source"]: r for r in reached_shares(mix, targets).collect()}
    assert shares["a"]["most_copies"] <= 1 and shares["b"]["most_copies"] <= 2 and shares["none"]["share"] == 0
    assert abs(shares["a"]["share"] - 1 / 3) < 0.01 and abs(shares["b"]["share"] - 2 / 3) < 0.01
    assert mix_sources(df.limit(0), targets).count() == 0


# --- pieces ----------------------------------------------------------------


def test_split_oversized(spark, reference):
    texts = {
        1: "One two three. " * 60, 2: "x" * 4000, 3: "", 4: None, 5: "short", 6: "ضغط الدم مرتفع. " * 40, 7: "para one.\n\npara two is here.\n\n" * 20, 8: "nolimit " * 200, 9: "  \n" * 300,
    }
    df = spark.createDataFrame([(k, t, "none" if k == 8 else "a", 0) for k, t in texts.items()], "doc_id bigint, text string, kind string, piece int")
    limits = spark.createDataFrame([("a", 40, 6), ("a", 40, 6), (None, 9, 0)], "kind string, max_tokens int, overlap_tokens int")
    rows = split_oversized(df, limits).orderBy("doc_id", "piece").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 2, 5, 6, 7, 8, 9} and len(by[8]) == 1 == len(by[5])
    for k, pieces in by.items():
        assert pieces[0]["first"] == 0 and pieces[-1]["last"] == len(texts[k]) and [p["piece"] for p in pieces] == list(range(1, len(pieces) + 1))
        for p in pieces:
            assert p["text"] == texts[k][p["first"] : p["last"]] and p["n_tokens"] == len(reference.encode_ordinary(p["text"]))
            assert k == 8 or p["n_tokens"] <= 40
        for p, n in zip(pieces, pieces[1:]):
            assert p["first"] < n["first"] <= p["last"] < n["last"]
            if k in (1, 6):
                shared = len(reference.encode_ordinary(texts[k][n["first"] : p["last"]]))
                assert 6 <= shared <= 16
    assert sum(p["text"].endswith(".") for p in by[1][:-1]) >= 0.8 * (len(by[1]) - 1)
    assert split_oversized(df.limit(0), limits).count() == 0


def test_composition_is_of_the_unicode_data():
    assert unicodedata.normalize("NFC", Transducer()("é")) == "é" and F is not None
