"""Groups of records whose texts share most of their word runs.

A size-aware set-similarity join. Sets below a size boundary enumerate
two-element subsets of their prefixes; sets above it scan inverted lists of
single elements. The boundary is where the two costs, counted on the data,
meet. Candidates are then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.blocks import BLOCK_ROWS, meets, pair_blocks
from scanloom.session import materialise

def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, wrapping around."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_runs(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sets of all runs of ``words`` consecutive words of the lower-cased texts, sorted, one after the other.

    Words are what white space separates; a text of fewer words has an empty set.
    """
    import xxhash

    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([w for x in split for w in x], pa.large_string()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    word = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
    run = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        run = _mixed(run + word[k : len(word) - words + 1 + k])
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = row[: len(run)] == row[words - 1 : words - 1 + len(run)]
    row, run = row[: len(run)][whole], run[whole].view(np.int64)
    order = np.lexsort((run, row))
    row, run = row[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    return run[new], np.bincount(row[new], minlength=len(sizes))


def record_sets(df: DataFrame, sides: list[tuple[str, str]], words: int) -> DataFrame:
    """(``record``, ``sig1``, ``sig2``, ``n``, ``runs``) of each record of the (id column, text column) sides that has a run.

    A record that stands in several rows counts once; should its texts differ,
    the smallest by code point is taken. Null ids and null or empty texts are left out.
    The two hashes ``sig1`` and ``sig2`` together identify the set.
    """
    pairs = F.array(*(F.struct(F.col(key).cast("bigint").alias("record"), F.col(text).cast("string").alias("t")) for key, text in sides))
    texts = df.select(F.explode(pairs).alias("x")).select("x.record", "x.t").where("record is not null and t != ''").groupBy("record").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, sizes = word_runs(batch.column(1).to_pylist(), words)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["record", "runs"])

    sets = texts.mapInArrow(run, "record bigint, runs array<bigint>").where("size(runs) > 0")
    return sets.select("record", F.xxhash64(F.lit(1), "runs").alias("sig1"), F.xxhash64(F.lit(2), "runs").alias("sig2"), F.size("runs").alias("n"), "runs")


#: Emitting, shuffling and sorting a subset counts as this many looks at a pair of entries of a list, by measurement.
SUBSET_COST = 80
#: Elements are coloured by hash; two sets that share one element more than there are colours share two of one colour.
COLOURS = 12
#: 64-bit words of the bitmap that goes with an entry.
BITMAP_WORDS = 4
#: Counters of a sketch of frequencies, a fixed number whatever the data: one byte each where it is broadcast.
COUNTERS = 1 << 22
#: Steps in which a counter's size is kept, to the power of two.
STEPS = 8
#: Elements that are worked on at once in a Python worker, and entries of lists that are compared at once.
SLICE, ENTRIES = 400_000, 100_000


def _levels(counted: DataFrame, least: int = 2) -> np.ndarray:
    """A byte for each counter of (c, n) rows: 0 for less than ``least``, else the size in steps, rounded up."""
    level = F.greatest(F.lit(1), F.least(F.lit(255), F.ceil(STEPS * F.log2("n") - 1e-9))).cast("smallint")
    rows = counted.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("c", level.alias("level")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[rows.column("c").to_numpy()] = rows.column("level").to_numpy()
    return out


def _reach(n: np.ndarray, threshold: float) -> np.ndarray:
    return (n - np.ceil(threshold * n - 1e-9) + 1).astype(np.int64)


class _Sets:
    """Sets of a record batch with their elements from rare to frequent, in flat arrays."""

    def __init__(self, batch: pa.RecordBatch, levels: np.ndarray) -> None:
        self.sid = batch.column("sid").to_numpy()
        lists = batch.column("runs")
        values = lists.flatten().to_numpy()
        self.n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        level = levels[values & (COUNTERS - 1)]
        order = np.argsort(self.row << 8 | level, kind="stable")  # elements of a set come sorted
        self.h, self.level = values[order], level[order]
        starts = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(self.row)) - starts[self.row] + 1
        bits = np.zeros((len(self.n), BITMAP_WORDS), np.uint64)
        word, bit = (values >> 8) % BITMAP_WORDS, np.left_shift(np.uint64(1), (values & 63).astype(np.uint64))
        np.bitwise_or.at(bits, (self.row, word), bit)
        self.bits = bits.view(np.int64)

    def prefix(self, threshold: float, more: int = 0) -> np.ndarray:
        """Places of the elements of the prefixes that another set may hold too."""
        return np.flatnonzero((self.pos <= (_reach(self.n, threshold) + more)[self.row]) & (self.level > 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("runs").offsets.to_numpy()))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _counters(keys: np.ndarray) -> pa.RecordBatch:
    c, n = np.unique(keys & (COUNTERS - 1), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n)], names=["c", "n"])


def _subsets(s: _Sets, light: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, level of the rarer element) of the two-element subsets of one colour of the longer prefixes of light sets."""
    at = s.prefix(threshold, COLOURS)
    at = at[light[s.row[at]]]
    # Colours by other bits of the hash than counters and bitmaps.
    colour = (s.h[at] >> 40) % COLOURS
    order = np.argsort((s.row[at] * COLOURS + colour) << 20 | np.minimum(s.pos[at], (1 << 20) - 1), kind="stable")
    at, group = at[order], (s.row[at] * COLOURS + colour)[order]
    rows, keys, level = [], [], []
    d = 1
    i = np.arange(len(at) - 1)
    while len(i):
        i = i[i + d < len(at)]
        i = i[group[i] == group[i + d]]
        x, y = s.h[at[i]], s.h[at[i + d]]
        low, high = np.minimum(x, y).view(np.uint64), np.maximum(x, y).view(np.uint64)
        keys.append(_mixed(_mixed(low) + high).view(np.int64))
        rows.append(s.row[at[i]])
        level.append(np.minimum(s.level[at[i]], s.level[at[i + d]]))
        d += 1
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(level)


def _blocks(level: np.ndarray, block_rows: int) -> np.ndarray:
    """In how many parts a list is cut; its size is at most that of its counter."""
    return np.ceil(np.exp2(level / STEPS) / block_rows - 1e-9).astype(np.int64).clip(1)


ENTRY = "h bigint, block bigint, part int, sid bigint, n int, pos int, large boolean, " + ", ".join(f"w{k} bigint" for k in range(BITMAP_WORDS))


def _entries(s: _Sets, row: np.ndarray, h: np.ndarray, pos: np.ndarray, large: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``ENTRY``; an entry of a list in b parts is sent to the b pairs of parts that hold its own."""
    own = (s.sid[row] ^ (s.sid[row] >> 17)) % parts
    copy = np.repeat(np.arange(len(row)), parts)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(parts) - parts, parts)
    own, row = own[copy], row[copy]
    block = np.minimum(own, other) << 31 | np.maximum(own, other)
    arrays = [h[copy], block, own.astype(np.int32), s.sid[row], s.n[row].astype(np.int32), pos[copy].astype(np.int32), large[row]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*arrays, *s.bits[row].T)], names=[c.split()[0] for c in ENTRY.split(", ")])


def _listed(rows: DataFrame, threshold: float, by_position: bool) -> DataFrame:
    """(``a``, ``b``), a < b: entries of one list whose sizes, places and bitmaps allow ``threshold``.

    One shuffle brings the entries of a list, or of two parts of it, together;
    they are compared in vectorised steps over runs of equal keys.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    c = threshold / (1 + threshold)

    def compare(x: dict[str, np.ndarray]) -> np.ndarray:
        h, block, size = x["h"], x["block"], x["n"].astype(np.int64)
        new = np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1])) + 1
        end = np.repeat(np.append(new, len(h)), np.diff(np.concatenate(([0], new, [len(h)]))))
        bits = np.stack([x[f"w{k}"] for k in range(BITMAP_WORDS)], 1).view(np.uint64)
        i, d, out = np.arange(len(h)), 1, []
        crossing = (block >> 31) != (block & 0x7FFFFFFF)
        while True:
            i = i[i + d < end[i]]
            if not len(i):
                break
            j = i + d
            if by_position:
                some = x["large"][i] | x["large"][j]
                p, q = i[some], j[some]
            else:
                p, q = i, j
            set_bits = np.bitwise_count(bits[p] ^ bits[q])
            differing = sum(set_bits[:, k].astype(np.int16) for k in range(BITMAP_WORDS))
            both = size[p] + size[q]
            need = np.ceil(c * both - 1e-9)
            ok = differing <= both - 2 * need
            p, q, need = p[ok], q[ok], need[ok]
            ok = (np.minimum(size[p], size[q]) >= need) & (~crossing[p] | (x["part"][p] != x["part"][q]))
            if by_position:
                ok &= np.minimum(size[p] - x["pos"][p], size[q] - x["pos"][q]) + np.minimum(x["pos"][p], x["pos"][q]) >= need
            a, b = x["sid"][p[ok]], x["sid"][q[ok]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            d += 1
        if not out:
            return np.zeros((0, 2), np.int64)
        found = np.unique(np.concatenate(out), axis=0)
        return found[found[:, 0] < found[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def taken(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            x = {f: table.column(f).to_numpy() for f in table.column_names}
            # The last list may go on in the next batch.
            same = np.flatnonzero((x["h"] != x["h"][-1]) | (x["block"] != x["block"][-1]))
            cut = len(x["h"]) if last else int(same[-1]) + 1 if len(same) else 0
            waiting[:] = table.slice(cut).to_batches()
            if cut:
                found = compare({f: v[:cut] for f, v in x.items()})
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        rows_waiting = 0
        for batch in batches:
            waiting.append(batch)
            rows_waiting += batch.num_rows
            if rows_waiting >= ENTRIES:
                yield from taken(False)
                # A list longer than that is waited for without looking at each batch.
                rows_waiting = sum(b.num_rows for b in waiting) if sum(b.num_rows for b in waiting) < ENTRIES else 0
        if sum(b.num_rows for b in waiting):
            yield from taken(True)

    near = rows.repartition(tasks, "h", "block").sortWithinPartitions("h", "block")
    return near.mapInArrow(run, "a bigint, b bigint")


def size_boundary(costs: list[tuple[int, float, float]]) -> int:
    """Sets smaller than this enumerate subsets, others scan lists; the cheapest split of (size, scan, subsets) by cost."""
    value = best = sum(scan for _, scan, _ in costs)
    at = 0
    for n, scan, subsets in sorted(costs):
        value += subsets * SUBSET_COST - scan
        if value < best:
            best, at = value, n + 1
    return at


def similar_sets(sets: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``a``, ``b``, ``similarity``): pairs of different sets, a < b, with a Jaccard similarity of at least ``threshold``.

    ``sets`` has ``sid`` (bigint), ``n`` and ``runs`` (sorted), one row for each
    different set. Exact: elements are ordered from rare to frequent. Two sets
    that are similar enough share one element of their prefixes of
    n - ceil(t n) + 1 elements, and k of prefixes longer by k - 1. Light sets
    enumerate the two-element subsets of one colour of the longer prefix, which
    catches every pair by the pigeonhole principle; heavy sets, and those too
    small for it, scan the lists of the short prefix. How rare an element is
    comes from a sketch with a fixed number of counters over all sets, which
    every worker gets; counters that share elements change the order, and so
    the cost, but not the result. An element alone on its counter is in one set
    only and is but counted. Lists of any length are compared in blocks.
    """
    sc = sets.sparkSession.sparkContext

    def sketch(levels, keys_of, least: int = 2) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                yield _counters(keys_of(part, levels))

        return _levels(sets.select("sid", "runs").mapInArrow(run, "c int, n bigint"), least)

    frequent = sc.broadcast(sketch(None, lambda part, _: part.column("runs").flatten().to_numpy()))

    def short(part, levels):
        s = _Sets(part, levels.value)
        return s.h[s.prefix(threshold)]

    listed = sc.broadcast(sketch(frequent, short))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            s = _Sets(part, frequent.value)
            at = s.prefix(threshold)
            scan = np.bincount(s.row[at], np.exp2(listed.value[s.h[at] & (COUNTERS - 1)] / STEPS) / 2, len(s.n))
            row, _, _ = _subsets(s, np.ones(len(s.n), bool), threshold)
            size, place = np.unique(s.n, return_inverse=True)
            sums = (np.bincount(place, scan), np.bincount(place, np.bincount(row, minlength=len(s.n)).astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array(size), *map(pa.array, sums)], names=["n", "scan", "subsets"])

    # One row for each size of a set.
    costs = sets.select("sid", "runs").mapInArrow(cost, "n bigint, scan double, subsets double").groupBy("n").agg(F.sum("scan").alias("scan"), F.sum("subsets").alias("subsets"))
    boundary = size_boundary([tuple(r) for r in costs.collect()])

    def heavy(n: np.ndarray) -> np.ndarray:
        # Fewer shared elements than colours are no basis for subsets.
        return (n >= boundary) | (np.ceil(threshold * n - 1e-9) <= COLOURS)

    def of_heavy(part, levels):
        s = _Sets(part, levels.value)
        at = s.prefix(threshold)
        return s.h[at[heavy(s.n)[s.row[at]]]]

    # Lists without a heavy set are covered by the subsets.
    scanned = sc.broadcast(sketch(frequent, of_heavy, 1))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            s = _Sets(part, frequent.value)
            at = s.prefix(threshold)
            at = at[scanned.value[s.h[at] & (COUNTERS - 1)] > 0]
            yield _entries(s, s.row[at], s.h[at], s.pos[at], heavy(s.n), _blocks(listed.value[s.h[at] & (COUNTERS - 1)], block_rows))

    candidates = _listed(sets.select("sid", "runs").mapInArrow(single, ENTRY), threshold, True)
    if boundary > 0:
        hot = None
        if np.exp2(int(frequent.value.max()) / STEPS) > block_rows:
            # Only subsets of two elements that are frequent themselves can have a long list.
            def long(part, levels):
                s = _Sets(part, levels.value)
                _, keys, level = _subsets(s, ~heavy(s.n), threshold)
                return keys[np.exp2(level / STEPS) > block_rows]

            hot = sc.broadcast(sketch(frequent, long))

        def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                s = _Sets(part, frequent.value)
                row, keys, level = _subsets(s, ~heavy(s.n), threshold)
                if hot is not None:
                    level = np.minimum(level, np.maximum(hot.value[keys & (COUNTERS - 1)], STEPS))
                yield _entries(s, row, keys, np.zeros(len(row), np.int64), np.zeros(len(s.n), bool), _blocks(level, block_rows))

        candidates = candidates.unionByName(_listed(sets.select("sid", "runs").mapInArrow(double, ENTRY), threshold, False))
    candidates = candidates.distinct()

    x = sets.select(F.col("sid").alias("a"), F.col("runs").alias("ra"), F.col("n").alias("na"))
    y = sets.select(F.col("sid").alias("b"), F.col("runs").alias("rb"), F.col("n").alias("nb"))
    common = F.size(F.array_intersect("ra", "rb"))
    # Sides grow with the data: no side is broadcast on an estimate of its size.
    both = candidates.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    verified = both.withColumn("i", common).withColumn("similarity", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return verified.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


class NearDuplicates:
    """The parts of one run: ``members`` (record, sid) and ``links`` between different sets (a, b, similarity)."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links


def find_near_duplicates(df: DataFrame, sides: list[tuple[str, str]], threshold: float = 0.8, words: int = 5, block_rows: int = BLOCK_ROWS) -> NearDuplicates:
    """Records with the same set of runs form a class (``sid``, its smallest record); classes are linked by similarity.

    Texts of fewer than ``words`` words have no run and are similar to none.
    """
    records = materialise(record_sets(df, sides, words))
    classes = records.groupBy("sig1", "sig2").agg(F.min("record").alias("sid"))
    members = materialise(records.select("record", "sig1", "sig2").join(classes.hint("merge"), ["sig1", "sig2"]).select("record", "sid"))
    first = members.where("record = sid").select("sid")
    sets = materialise(records.join(first.hint("merge"), F.col("record") == F.col("sid")).select("sid", "n", "runs"))
    return NearDuplicates(members, materialise(similar_sets(sets, threshold, block_rows)))


def record_pairs(found: NearDuplicates, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``record_a``, ``record_b``), smaller first: every two similar records, exact copies included."""
    members = found.members
    size = members.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")
    copies = pair_blocks(members, ["sid"], F.col("record"), size, block_rows)
    a = copies.select("sid", "_lo", "_hi", F.col("_part").alias("p"), F.col("record").alias("record_a"))
    b = copies.select("sid", "_lo", "_hi", F.col("_part").alias("p2"), F.col("record").alias("record_b"))
    same = a.join(b.hint("merge"), ["sid", "_lo", "_hi"]).where((F.col("record_a") < F.col("record_b")) & meets(F.col("p"), F.col("p2"), F.col("_lo"), F.col("_hi"))).select("record_a", "record_b")
    x = members.select(F.col("sid").alias("a"), F.col("record").alias("x"))
    y = members.select(F.col("sid").alias("b"), F.col("record").alias("y"))
    across = found.links.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
    return same.unionByName(across)


def connected(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(``node``, ``root``): the smallest node that each node of an edge is connected with.

    Large-star and small-star rounds until nothing changes, each cut by a
    checkpoint; a round joins nothing and groups by node.
    """
    work = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours larger than a node go to its smallest neighbour (or itself).
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: neighbours smaller than a node go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        work = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("connected() did not settle")


def record_groups(found: NearDuplicates) -> DataFrame:
    """(``record``, ``class_id``, ``links``, ``group_id``) of every record with a run.

    ``links`` counts similar records of other classes and exact copies;
    ``group_id`` is the smallest record of the group that links form.
    """
    members, links = found.members, found.links
    size = members.groupBy("sid").agg(F.count("*").alias("n"))
    ends = links.select(F.col("a").alias("sid"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("sid"), F.col("a").alias("o")))
    other = ends.join(size.select(F.col("sid").alias("o"), "n").hint("merge"), "o").groupBy("sid").agg(F.sum("n").alias("far"))
    roots = connected(links, "a", "b").select(F.col("node").alias("sid"), "root")
    info = size.join(other.hint("merge"), "sid", "left").join(roots.hint("merge"), "sid", "left")
    out = members.join(info.hint("merge"), "sid")
    return out.select("record", F.col("sid").alias("class_id"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("root", "sid").alias("group_id"))
