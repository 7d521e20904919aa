from __future__ import annotations

import random

import numpy as np

from scanloom.functions.metrics import common_length, ratio
from scanloom.operators import records as C


def test_greedy_unique_in_blocks_is_the_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(C, "TEXTS_AT_ONCE", 20)
    random.seed(4)
    words = ["acute otitis", "knee", "فقر الدم", "mild asthma; ", "tonsillitis", "x" * 70, "burn\n"]
    text = lambda: random.choice([None, "", "aaa", " ".join(random.choices(words, k=random.randrange(1, 4)))])
    rows = [(random.choice([None, "a", "a", "b", ""]), i // 2, text()) for i in range(400)]
    rows += [("c", 7, "knee joint b"), ("c", 7, "knee joint a"), ("c", 7, "knee joint c")]
    got = [tuple(r) for r in C.greedy_unique(spark.createDataFrame(rows, "g string, i bigint, t string").repartition(5), "g", "i", "t").collect()]
    want = []
    for g in {r[0] for r in rows}:
        kept = []
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] or "")):
            hit = next((k for k, u in kept if ratio(t or "", u) >= 85), None)
            want.append((g, i, t, hit, hit is None))
            if hit is None:
                kept.append((i, t or ""))
    bare = lambda x: sorted(((g, i, t or "", d, k) for g, i, t, d, k in x), key=str)
    assert bare(got) == bare(want) and len({r[3] for r in got}) > 10
    assert [r[2] for r in got if r[0] == "c" and r[4]] == ["knee joint a"]


def test_common_lengths_of_many_pairs():
    random.seed(1)
    texts = ["".join(random.choices("abc؟", k=random.randrange(200))) for _ in range(30)] + ["", "x" * 64, "x" * 65, "x" * 128]
    i, j = np.array([(a, b) for a in range(len(texts)) for b in range(len(texts))]).T
    assert C._common_lengths(texts, texts, i, j).tolist() == [common_length(texts[a], texts[b]) for a, b in zip(i, j)]
