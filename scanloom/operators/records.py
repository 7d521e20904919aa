"""Records compared by weighted fields, deduplicated in order, searched by text and by vector; terms suggested."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.metrics import hamming, indel_ratio, ratio, token_set_ratio
from scanloom.operators.blocks import meets, pair_blocks
from scanloom.session import materialise

# What the fields of a record count for, and what makes two records one patient.
WEIGHTS = {"patient_name": 0.35, "patient_id": 0.30, "date": 0.15, "diagnosis": 0.10, "medications": 0.05, "template": 0.05}
SAME_SCORE, SAME_NAME, SAME_ID = 0.85, 0.92, 0.98


def field_similarity(df: DataFrame, pairs: dict[str, tuple[str, str]], name: str = "similarity") -> DataFrame:
    """``df`` with a struct: ``score`` (4 places), ``same_patient`` and the similarity of each field.

    A field counts where either side is not empty, so a one-sided field lowers
    the score; two empty ones are equal but don't count. Equality of names or
    ids of a high degree is needed for one patient.
    """
    out = df
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, (a, b) in pairs.items():
        x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
        out = out.withColumn(f"_s_{f}", F.round(indel_ratio(x, y) / 100, 4))
        counts = (x != "") | (y != "")
        total = total + F.when(counts, F.col(f"_s_{f}") * WEIGHTS[f]).otherwise(0.0)
        weight = weight + F.when(counts, WEIGHTS[f]).otherwise(0.0)
    score = F.round(F.when(weight > 0, total / weight).otherwise(0.0), 4)
    key = F.lit(False)
    if "patient_name" in pairs:
        key = key | (F.col("_s_patient_name") >= SAME_NAME)
    if "patient_id" in pairs:
        key = key | (F.col("_s_patient_id") >= SAME_ID)
    parts = [F.col(f"_s_{f}").alias(f) for f in pairs]
    return out.withColumn(name, F.struct(score.alias("score"), ((score >= SAME_SCORE) & key).alias("same_patient"), *parts)).drop(*(f"_s_{f}" for f in pairs))


def pair_confidence(field: Column, template: Column, turned: Column) -> Column:
    """0.6 of the fields' similarity, 0.3 of the templates', 0.1 for text direction (half if it had to be repaired)."""
    return F.round(0.6 * field + 0.3 * template + 0.1 * F.when(turned, 0.5).otherwise(1.0), 4)


#: Pairs whose common subsequences are computed at once, and the longest text for which they are.
PAIRS_AT_ONCE, LONGEST = 4096, 256
#: Texts of one part of a large group.
TEXTS_AT_ONCE = 5000


def _common_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``common_length`` of the pairs (left[i], right[j]), by bits of 64-bit words for all pairs at once."""
    alphabet: dict[str, int] = {}
    used, at = np.unique(i, return_inverse=True)
    other, to = np.unique(j, return_inverse=True)
    a, b = [left[k] for k in used], [right[k] for k in other]
    codes = np.zeros((len(b), max(map(len, b), default=0)), "int64")  # 0 is no character
    for row, t in enumerate(b):
        codes[row, : len(t)] = [alphabet.setdefault(c, len(alphabet) + 1) for c in t]
    words = max(1, -(-max(map(len, a), default=0) // 64))
    masks = np.zeros((len(a), len(alphabet) + 1, words), "uint64")
    full = np.zeros((len(a), words), "uint64")
    for row, t in enumerate(a):
        bits: dict[int, int] = {}
        for k, c in enumerate(t):
            if c in alphabet:
                bits[alphabet[c]] = bits.get(alphabet[c], 0) | 1 << k
        for c, v in [*bits.items(), (-1, (1 << len(t)) - 1)]:
            for w in range(words):
                part = v >> 64 * w & 2**64 - 1
                if c < 0:
                    full[row, w] = part
                else:
                    masks[row, c, w] = part
    s = [full[at, w].copy() for w in range(words)]
    one = np.uint64(1)
    for k in range(codes.shape[1]):
        c = codes[to, k]
        carry = None
        for w in range(words):
            m = masks[at, c, w]
            u = s[w] & m
            total = s[w] + u
            over = total < u
            if carry is not None:
                total = total + carry
                over |= (total == 0) & (carry == one)
            carry = over.astype("uint64")
            s[w] = total | (s[w] & ~u)
    rest = sum(np.bitwise_count(s[w] & full[at, w]).astype("int64") for w in range(words))
    return np.array([len(t) for t in a], "int64")[at] - rest


def _similar(left: list[str], right: list[str], threshold: float) -> list[tuple[int, int]]:
    """Places of the pairs whose ``ratio`` is at least ``threshold``.

    Two texts have no longer common subsequence than characters in common, each
    as often as both hold it; those are counted for all pairs at once, as
    products of the rows of one column for the first, second, ... occurrence of
    a character. Only the pairs that may reach the threshold are looked at.
    """
    columns: dict[tuple[str, int], int] = {}

    def coded(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            seen: dict[str, int] = {}
            row = []
            for c in t:
                n = seen[c] = seen.get(c, 0) + 1
                row.append(columns.setdefault((c, n), len(columns)))
            out.append(row)
        return out

    def matrix(rows: list[list[int]]) -> np.ndarray:
        m = np.zeros((len(rows), len(columns)), "float32")
        m[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([k for r in rows for k in r], "int64")] = 1
        return m

    one, two = (sorted(range(len(t)), key=lambda k, t=t: len(t[k])) for t in (left, right))
    x, y = coded([left[k] for k in one]), coded([right[k] for k in two])
    many = matrix(y)
    n, m = np.array([len(r) for r in x], "float64"), np.array([len(r) for r in y], "float64")
    one, two = np.array(one, "int64"), np.array(two, "int64")
    maybe: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), 128):
        part = n[at : at + 128]
        near = [200 * np.minimum(e, m) >= threshold * (e + m) for e in (part[0], part[-1])]
        ok = np.flatnonzero(near[0] | near[1] | ((m >= part[0]) & (m <= part[-1])))
        if len(ok):
            low, high = ok[0], ok[-1] + 1
            common = matrix(x[at : at + 128]) @ many[low:high].T
            p, q = np.nonzero(common >= (threshold / 200 - 1e-5) * (part[:, None] + m[None, low:high]).astype("float32"))
            maybe.append((at + p, low + q))
    found: list[tuple[int, int]] = []
    p, q = (np.concatenate([v[k] for v in maybe]) if maybe else np.zeros(0, "int64") for k in range(2))
    for k in range(0, len(p), PAIRS_AT_ONCE):
        f, g = p[k : k + PAIRS_AT_ONCE], q[k : k + PAIRS_AT_ONCE]
        i, j, total = one[f], two[g], n[f] + m[g]
        if max(n[f].max(), m[g].max()) > LONGEST:
            ok = np.array([ratio(left[c], right[d]) >= threshold for c, d in zip(i.tolist(), j.tolist())])
        else:
            ok = np.where(total > 0, 200.0 * _common_lengths(left, right, i, j) / np.maximum(total, 1), 100.0) >= threshold
        found += list(zip(i[ok].tolist(), j[ok].tolist()))
    return found


def similar_pairs(rows: DataFrame, group: str, number: str, text: str, threshold: float) -> DataFrame:
    """(``group``, ``a``, ``b``), smaller number first: the pairs of a group whose ``ratio`` is at least ``threshold``. Large groups are compared in blocks."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        one, two = pdf[pdf["_part"] == lo], pdf[pdf["_part"] == hi]
        if not len(one) or not len(two):
            return pd.DataFrame({group: [], "a": [], "b": []})
        places = _similar(one[text].tolist(), two[text].tolist(), threshold)
        x, y = one[number].to_numpy()[[i for i, _ in places]], two[number].to_numpy()[[j for _, j in places]]
        out = pd.DataFrame({group: pdf[group].iloc[0], "a": np.minimum(x, y), "b": np.maximum(x, y)})
        out = out[out["a"] < out["b"]]
        return out.drop_duplicates() if lo == hi else out

    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    spread = pair_blocks(rows.select(group, number, text), [group], F.col(number), sizes, TEXTS_AT_ONCE)
    keys = [group, "_lo", "_hi"]
    # Much work on few bytes: a fixed number of partitions, which isn't made smaller.
    spread = spread.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
    return spread.groupBy(*keys).applyInPandas(compare, f"{group} string, a bigint, b bigint")


def greedy_unique(df: DataFrame, block: str, order: str, text: str, threshold: float = 85.0) -> DataFrame:
    """``df`` with ``kept`` and ``duplicate_of``: in order, a row is a duplicate of the first kept row that is similar enough; equal ones in order are taken by text.

    All pairs of a block are compared, in parts by many tasks. The order decides
    then among the similar pairs of a block, which are one fold.
    """

    def fold(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["b", "a"])
        of: dict[int, int] = {}
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            if b not in of and a not in of:
                of[b] = a
        return pd.DataFrame({"_g": pairs["_g"].iloc[0], "_n": list(of.keys()), "_of": list(of.values())})

    g = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    numbered = df.select("*", g.alias("_g"), t.alias("_t")).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.col(order).asc_nulls_last(), "_t")).cast("bigint"))
    rows = materialise(numbered)
    of = similar_pairs(rows, "_g", "_n", "_t", threshold).groupBy("_g").applyInPandas(fold, "_g string, _n bigint, _of bigint")
    first = rows.select("_g", F.col("_n").alias("_of"), F.col(order).cast("bigint").alias("duplicate_of"))
    hits = of.join(first, ["_g", "_of"])
    return rows.join(hits, ["_g", "_n"], "left").select(*df.columns, "duplicate_of", F.col("_of").isNull().alias("kept"))


def greedy_clusters(df: DataFrame, block: str, order: str, bits: str, threshold: int = 5) -> DataFrame:
    """``df`` with ``cluster`` (its representative's key) and ``distance``: the nearest representative within ``threshold`` bits, the first of equals."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        heads: list[tuple[int, int]] = []
        cluster, distance = [], []
        for key, b in zip(rows[order], rows[bits]):
            b = int(b) & (2**64 - 1)
            d, k = min(((b ^ h).bit_count(), i) for i, (_, h) in enumerate(heads)) if heads else (65, 0)
            if d <= threshold:
                cluster.append(heads[k][0])
                distance.append(d)
            else:
                heads.append((key, b))
                cluster.append(key)
                distance.append(0)
        rows = rows.copy()
        rows["cluster"], rows["distance"] = cluster, distance
        return rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "cluster bigint, distance int"])
    return df.groupBy(block).applyInPandas(fold, schema)


def hamming_pairs(df: DataFrame, key: str, bits: str, within: int) -> DataFrame:
    """(``key``, ``other``, ``d``) of the pairs of different keys, smaller first, whose 64-bit hashes differ in at most ``within`` bits.

    Exact: of ``within`` + 1 bands of the hash one at least is equal in both. A
    pair is made in the first band that they share only, and rows that share a
    band are compared in blocks.
    """
    cuts = [64 * k // (within + 1) for k in range(within + 2)]

    def band(c: Column, k: int) -> Column:
        return F.shiftrightunsigned(c, 64 - cuts[k + 1]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1 if within else -1).cast("bigint"))

    bands = F.posexplode(F.array(*(band(F.col("_b"), k) for k in range(within + 1))))
    rows = materialise(df.select(F.col(key).alias("_k"), F.col(bits).alias("_b")).distinct().select("_k", "_b", bands.alias("_band", "_value")))
    group = ["_band", "_value"]
    spread = pair_blocks(rows, group, F.col("_k"), rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"))
    keys = [*group, "_lo", "_hi"]
    a = spread.select(*keys, F.col("_k").alias(key), F.col("_b").alias("x"), F.col("_part").alias("p"))
    b = spread.select(*keys, F.col("_k").alias("other"), F.col("_b").alias("y"), F.col("_part").alias("q"))
    x, y = F.col("x"), F.col("y")
    first = F.coalesce(*(F.when(band(x, k) == band(y, k), F.lit(k)) for k in range(within + 1)))
    near = (F.col(key) < F.col("other")) & meets(F.col("p"), F.col("q"), F.col("_lo"), F.col("_hi")) & (hamming(x, y) <= within) & (first == F.col("_band"))
    return a.join(b, keys).where(near).select(key, "other", hamming(x, y).alias("d"))


def greedy_clusters_of_all(df: DataFrame, order: str, bits: str, threshold: int = 5) -> DataFrame:
    """``greedy_clusters`` over all rows as one block, without sending them to one task.

    A row is a representative where no earlier row within ``threshold`` bits is
    one. Only such pairs are looked at, in rounds: as many as the longest run of
    rows that wait for each other.
    """
    pairs = materialise(hamming_pairs(df, order, bits, threshold).select(F.col(order).alias("head"), "other", "d"))
    schema = pairs.select("other").schema
    heads = df.sparkSession.createDataFrame([], schema)
    left = pairs.select(F.col("head").alias("other")).union(pairs.select("other")).distinct()
    while not left.isEmpty():
        waits = pairs.join(left.withColumnRenamed("other", "head"), "head").select("other").distinct()
        new = materialise(left.join(waits, "other", "left_anti"))
        heads = heads.union(new)
        taken = pairs.join(new.withColumnRenamed("other", "head"), "head").select("other").distinct()
        left = materialise(left.join(new, "other", "left_anti").join(taken, "other", "left_anti"))
    near = pairs.join(heads.withColumnRenamed("other", "head"), "head").groupBy("other").agg(F.min(F.struct("d", "head")).alias("_near"))
    out = df.join(near.withColumnRenamed("other", order), order, "left")
    return out.withColumns({"cluster": F.coalesce("_near.head", order), "distance": F.coalesce("_near.d", F.lit(0))}).drop("_near")


def search(df: DataFrame, key: str, haystack: Column, diagnosis: Column, query: str, k: int) -> DataFrame:
    """The ``k`` rows most like a query: token-set ratio, a bonus where the diagnosis holds it; 0 is left out. A blank query finds nothing."""
    bonus = F.when(F.contains(F.lower(F.coalesce(diagnosis, F.lit(""))), F.lit(query.lower())), 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), token_set_ratio(F.lit(query), haystack) / 100 + bonus)
    found = df.withColumn("score", score).where((F.col("score") > 0) & F.lit(bool(query.strip())))
    return found.orderBy(F.desc("score"), key).limit(k)


#: Queries of one block of a vector search.
QUERIES_AT_ONCE = 4096


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(``query``, ``key``, ``similarity``): the k rows of the greatest cosine for each query row; equal ones by key.

    Each partition of the vectors keeps the k best of a query before they are
    shuffled. About ``QUERIES_AT_ONCE`` queries are sent to all tasks at a
    time; more of them are taken in as many blocks, each against all rows.
    """

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(dot(v, v))

    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"), norm(F.col(vector)).alias("_nq"))
    v = vectors.select(key, F.col(vector).alias("_v"), norm(F.col(vector)).alias("_nv"))
    blocks = max(1, -(-q.count() // QUERIES_AT_ONCE))
    parts = [q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) for i in range(blocks)]
    met = reduce(DataFrame.unionByName, (v.crossJoin(F.broadcast(part)) for part in parts))  # a block of queries against all rows
    scored = met.select("query", key, F.round(dot(F.col("_q"), F.col("_v")) / (F.col("_nq") * F.col("_nv")), 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def suggest_terms(tokens: DataFrame, word: str, terms: DataFrame, term: str, within: int = 2) -> DataFrame:
    """(word, term, distance): for each different word of three letters or more the nearest term, lengths no more than two apart; of equals the first.

    Joined by length, so that only terms of a similar length are compared.
    """
    w = tokens.select(F.lower(word).alias("word")).where("length(word) >= 3").distinct()
    t = terms.select(F.lower(term).alias("term")).where("term != ''").distinct().withColumn("_l", F.length("term"))
    near = w.withColumn("_l", F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - within), F.length("word") + within)))
    d = near.join(t, "_l").withColumn("distance", F.levenshtein("word", "term", within)).where("distance >= 0")
    return d.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("b")).select("word", "b.term", "b.distance")


def confirmed_pairs(clusters: DataFrame, cluster: str, key: str, text: str, threshold: float, similarity=indel_ratio) -> DataFrame:
    """(key_a, key_b, ratio) of the pairs of a cluster whose texts are similar enough. Clusters are small by construction."""
    a = clusters.select(cluster, F.col(key).alias("key_a"), F.col(text).alias("_a"))
    b = clusters.select(cluster, F.col(key).alias("key_b"), F.col(text).alias("_b"))
    pairs = a.join(b, cluster).where("key_a < key_b").withColumn("ratio", similarity(F.col("_a"), F.col("_b")))
    return pairs.where(F.col("ratio") >= threshold).select("key_a", "key_b", "ratio")
