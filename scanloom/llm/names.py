"""Spellings of one person's name linked to each other.

Names are parsed into family, given and middle name. Misspelt tokens and family
names find their right spelling by a trie join: the names of a shard are put in
a trie that a Levenshtein automaton traverses. Token order, titles, initials
and short forms are then compared within a family.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.blocks import meets, pair_blocks
from scanloom.session import materialise

# Words that are no part of a name, and values that name nobody.
TITLES = frozenset(
    "mr mrs ms miss mx dr doctor prof professor pt patient md phd rn sir السيد السيده الدكتور الدكتوره دكتور دكتوره الاستاذ الاستاذه المريض المريضه الحاج الحاجه د".split()
)
CONNECTIVES = frozenset("بن ابن بنت bin ibn bint".split())
JOINED_PREFIX = "عبد"
NOBODY = frozenset("unknown|unk|none|null|na|n/a|nil|not known|not given|anonymous|tbd|on call|غير معروف|مجهول|لا يوجد|غير محدد".split("|"))
SHAPES = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ـ": None})

#: A spelling this many times rarer than one a single edit away is taken for a slip of it.
RARER = 8
#: Words of a shard that one trie holds; larger shards are cut into parts.
TRIE_WORDS = 5000
#: Share of a short form's families in which its full form is found, at least, and how much more often than by chance.
SHORT_FORM_SHARE, SHORT_FORM_LIFT = 0.4, 4.0

_DEGREE = re.compile(r"[\s,،]+\(?(?:m\.\s?d\.?|md|ph\.\s?d\.?|phd)\)?$|\([^)]*\)")
_MARKS = re.compile(r"[ً-ْٰ]")


class LevenshteinAutomaton:
    """Accepts the words within ``k`` insertions, deletions, substitutions or swaps of neighbours of a word.

    A state is the last two rows of the edit table, entries beyond k + 1 cut to
    that; equal states are one, and their transitions are kept.
    """

    def __init__(self, word: str, k: int) -> None:
        self.word, self.k = word, k
        self.memo: dict[tuple, tuple] = {}

    def start(self) -> tuple:
        row = tuple(min(j, self.k + 1) for j in range(len(self.word) + 1))
        return (None, row, "")

    def step(self, state: tuple, c: str) -> tuple:
        known = self.memo.get((state, c))
        if known is None:
            before, row, last = state
            new = [min(row[0] + 1, self.k + 1)]
            for j, w in enumerate(self.word, 1):
                d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != c))
                if before is not None and j > 1 and w == last and self.word[j - 2] == c:
                    d = min(d, before[j - 2] + 1)
                new.append(min(d, self.k + 1))
            known = self.memo[state, c] = (row, tuple(new), c)
        return known

    def accepts(self, state: tuple) -> bool:
        return state[1][-1] <= self.k

    def alive(self, state: tuple) -> bool:
        return min(state[1]) <= self.k or (state[0] is not None and min(state[0]) < self.k)


class Trie:
    """Words by their letters."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, k: int) -> Iterator[str]:
        """The words within ``k`` edits of ``word``."""
        automaton = LevenshteinAutomaton(word, k)
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if automaton.accepts(state):
                        yield child
                    continue
                following = automaton.step(state, c)
                if automaton.alive(following):
                    stack.append((child, following))


def parse_name(name: str) -> tuple[list[str], int] | None:
    """(tokens without titles, number of them before a comma or 0), or None where a name names nobody.

    Case, accents' composition, Arabic letter variants and spaces are unified;
    single letters are initials; "Abd X" is one token.
    """
    s = _MARKS.sub("", unicodedata.normalize("NFKC", name)).casefold().translate(SHAPES).strip()
    if s in NOBODY or not any(c.isalpha() for c in s):
        return None
    s = _DEGREE.sub(" ", s).strip(" ,،")
    raw, before_comma, seen = [], 0, False
    for part in re.split(r"([,،])", s):
        if part in (",", "،"):
            seen = True
            continue
        found = []
        for word in re.split(r"[\s\-‐‑–_/]+", part):
            bits = [b for b in word.split(".") if any(c.isalpha() for c in b)]
            if not bits:
                continue
            dotted = "." in word
            found += [(re.sub(r"[^\w']", "", b), dotted) for b in bits]
        if not seen:
            before_comma = len(found)
        raw += found
    tokens: list[str] = []
    kept_before = 0
    letters = [t for t, _ in raw]
    for i, (t, dotted) in enumerate(raw):
        if t in TITLES:
            others = [x for j, x in enumerate(letters) if j != i and x not in TITLES and x not in CONNECTIVES]
            if len(t) > 1 or not dotted or len(others) > 1:
                continue
        if letters[:2] == ["ا", "د"] and i < 2 and dotted and len(raw) > 2:
            continue
        if t in CONNECTIVES and tokens:
            continue
        if tokens and tokens[-1] == JOINED_PREFIX:
            tokens[-1] += t
            continue
        tokens.append(t)
        kept_before += i < before_comma
    if not tokens:
        return None
    return tokens, kept_before if seen and 0 < kept_before < len(tokens) else 0


def _parsed(df: DataFrame, fields: list[str]) -> DataFrame:
    """(fld, name, tokens, comma) of the different strings that name somebody."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).cast("string").alias("name")) for f in fields))).alias("x"))
    names = stacked.select("x.*").where("name is not null and name != ''").distinct()

    @F.pandas_udf("tokens array<string>, comma int")
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = [parse_name(x) or (None, 0) for x in s]
        return pd.DataFrame({"tokens": [r[0] for r in rows], "comma": [r[1] for r in rows]})

    return names.withColumn("p", parse("name")).select("fld", "name", "p.tokens", "p.comma").where("size(tokens) > 1")


def _oriented(names: DataFrame) -> DataFrame:
    """(fld, name, family, given, middle): which token is the family name is told by where it stands in all other names."""
    last = F.element_at("tokens", -1)
    spot = F.when(F.col("comma") > 0, F.element_at("tokens", 1)).when(F.length(last) > 1, last)
    stats = names.select(F.explode("tokens").alias("w"), spot.alias("s")).where("length(w) > 1 and s is not null")
    stats = stats.groupBy("w").agg(((F.sum((F.col("w") == F.col("s")).cast("int")) + 1) / (F.count("*") + 2)).alias("family_like"))
    ends = names.where("comma = 0").select("fld", "name", F.explode(F.array(F.element_at("tokens", 1), last)).alias("w")).join(stats, "w")
    ends = ends.groupBy("fld", "name").agg(F.map_from_entries(F.collect_set(F.struct("w", "family_like"))).alias("likes"))
    out = names.join(ends, ["fld", "name"], "left")
    first = F.element_at("tokens", 1)
    n = F.size("tokens")
    like = lambda t: F.coalesce(F.element_at("likes", t), F.lit(0.5))
    at_end = (
        F.when(F.col("comma") > 0, False).when(F.length(last) == 1, False).when(F.length(first) == 1, True).otherwise(like(last) >= like(first))
    )
    out = out.withColumn("at_end", at_end)
    rest = F.when(F.col("comma") > 0, F.slice("tokens", F.col("comma") + 1, n)).when(F.col("at_end"), F.slice("tokens", F.lit(1), n - 1)).otherwise(F.slice("tokens", F.lit(2), n))
    # Without a comma a leading family name is followed by the others in reverse, unless these are initials.
    turned = (F.col("comma") == 0) & ~F.col("at_end") & (F.length(last) > 1)
    out = out.withColumn("rest", F.when(turned, F.reverse(rest)).otherwise(rest))
    family = F.when(F.col("comma") > 0, F.array_join(F.slice("tokens", F.lit(1), F.col("comma")), "")).when(F.col("at_end"), last).otherwise(first)
    family = F.when(family.startswith("ال") & (F.length(family) > 6), F.substring(family, 3, 100)).otherwise(family)
    return out.select("fld", "name", family.alias("family"), F.element_at("rest", 1).alias("given"), F.try_element_at("rest", F.lit(2)).alias("middle")).where("length(family) > 1")


def shard_keys(word: Column) -> Column:
    """The shards of a word: any two words a single edit apart, swaps included, share one.

    An edit is in one half of the shorter word, whose other half both words
    then have at the same end; a swap across the middle leaves what is around
    it. A word emits the halves for its own length and, for a longer word that
    lost a letter, for a length less one.
    """
    n = F.length(word)

    def halves(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        rest = m - h
        return [F.concat(F.lit("a"), m.cast("string"), F.substring(word, F.lit(1), h)), F.concat(F.lit("z"), m.cast("string"), F.substring(word, n - rest + 1, rest))]

    h = F.floor(n / 2).cast("int")
    around = F.concat(F.lit("x"), F.substring(word, F.lit(1), h - 1), F.lit("."), F.substring(word, h + 2, n))
    across = F.when(n > 1, F.array(around)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(*halves(n), *halves(n - 1)), across)


def _near_in_shards(df: DataFrame, groups: list[str], word: str, weight: str) -> DataFrame:
    """(groups, ``word``, ``near``, ``near_weight``) of the words of a group a single edit apart, by a trie for each shard.

    ``df`` has one row for each (groups, word) with its ``weight``. Exact: see
    ``shard_keys``. A shard of more than ``TRIE_WORDS`` words is cut into parts,
    and each two parts meet in a trie of their own.
    """
    schema = ", ".join([*(f"{g} string" for g in groups), f"{word} string, near string, near_weight bigint"])
    spread = df.select(*groups, word, F.col(weight).cast("bigint").alias("_w"), F.explode(shard_keys(F.col(word))).alias("_shard"))
    sizes = spread.groupBy(*groups, "_shard").agg(F.count("*").alias("n")).where("n > 1")
    keys = [*groups, "_shard", "_lo", "_hi"]
    blocks = pair_blocks(spread, [*groups, "_shard"], F.col(word), sizes, TRIE_WORDS).select(*keys, "_part", word, "_w")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    size, at = len(keys), len(groups)

    def met(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        weights = {r[size + 1]: r[size + 2] for r in rows}
        low, high = key[at + 1], key[at + 2]
        tree = Trie(r[size + 1] for r in rows if r[size] == low)
        for r in rows:
            if r[size] == high:
                for near in tree.near(r[size + 1], 1):
                    if near != r[size + 1]:
                        yield (*key[:at], r[size + 1], near, weights[near])
                        if low != high:
                            yield (*key[:at], near, r[size + 1], r[size + 2])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: set[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * (at + 3)
            types = [pa.string()] * (at + 2) + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*groups, word, "near", "near_weight"])

        key, rows = None, []
        for batch in batches:
            found: set[tuple] = set()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:size] != key:
                    if rows:
                        found.update(met(key, rows))
                    key, rows = row[:size], []
                rows.append(row)
            yield out(found)
        if rows:
            yield out(set(met(key, rows)))

    # Few bytes but much work: spread by number, not by size.
    return blocks.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(join, schema).distinct()


def _corrected(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Given and middle names with slips replaced by the spelling that is far more usual."""
    tokens = names.select("family", F.explode(F.array("given", "middle")).alias("w")).where("length(w) > 2").distinct()
    vocabulary = tokens.groupBy("w").agg(F.count("*").alias("n")).withColumn("g", F.lit(""))
    known = forms.select(F.explode(F.array("formal", "short")).alias("w")).distinct()
    near = _near_in_shards(materialise(vocabulary), ["g"], "w", "n").join(vocabulary.select("w", "n"), "w")
    slips = near.where((F.col("near_weight") >= RARER * F.col("n")) & (F.col("near_weight") >= 3)).join(known, "w", "left_anti")
    best = slips.groupBy("w").agg(F.max(F.struct("near_weight", "near")).alias("b")).select("w", F.col("b.near").alias("right"))
    out = names
    for c in ("given", "middle"):
        out = out.join(best.withColumnsRenamed({"w": c, "right": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select("fld", "name", "family", "given", "middle")


def _learned_forms(names: DataFrame) -> DataFrame:
    """(formal, short) that the data show: the full form stands in the families of the short one far more often than by chance.

    A short form is a given name that is no middle name.
    """
    given = names.where("length(given) > 2").select("family", F.col("given").alias("g")).distinct()
    use = given.groupBy("g").agg(F.count("*").alias("n"))
    middle = names.where("length(middle) > 2").groupBy(F.col("middle").alias("g")).agg(F.count("*").alias("m"))
    families = given.select(F.count_distinct("family").alias("all"))
    both = use.join(middle, "g", "left").fillna(0, ["m"])
    short = both.where("m <= 0.05 * n and n >= 4").select(F.col("g").alias("short"), F.col("n").alias("ns"))
    full = both.where("m > 0.2 * n and n >= 4").select(F.col("g").alias("formal"), F.col("n").alias("nf"))
    a = given.join(short, F.col("g") == F.col("short")).select("family", "short", "ns")
    b = given.join(full, F.col("g") == F.col("formal")).select("family", "formal", "nf")
    pair = a.join(b, "family").groupBy("short", "formal", "ns", "nf").agg(F.count("*").alias("c")).crossJoin(F.broadcast(families))  # one row
    ok = pair.where((F.col("c") >= SHORT_FORM_SHARE * F.col("ns")) & (F.col("c") * F.col("all") >= SHORT_FORM_LIFT * F.col("ns") * F.col("nf")) & (F.col("c") >= 3))
    return ok.select("formal", "short")


def _family_slips(names: DataFrame, shorts: DataFrame) -> DataFrame:
    """Names with a family name replaced by a more usual one a single edit away, of a person of the same given name.

    Short forms stand for their full forms too. One such neighbour is taken
    however rare it is, unless full middle names tell two people; of several
    the only one with an equal middle name or of far more strings is taken.
    """
    size = names.groupBy("fld", "family").agg(F.count("*").alias("size"))
    formals = shorts.groupBy(F.col("short").alias("given")).agg(F.collect_set("formal").alias("formals"))
    long = names.where("length(given) > 2 and length(family) > 4").select("fld", "given", "family", "middle").distinct().join(formals, "given", "left")
    keyed = long.withColumn("key", F.explode(F.array_union(F.array("given"), F.coalesce("formals", F.array().cast("array<string>")))))
    people = keyed.groupBy("fld", "key", "family").agg(F.collect_set(F.when(F.length("middle") > 2, F.col("middle"))).alias("middles"), F.collect_set("given").alias("givens"))
    people = materialise(people.join(size, ["fld", "family"]))
    near = _near_in_shards(people.select("fld", "key", "family", "size"), ["fld", "key"], "family", "size").join(people, ["fld", "key", "family"])
    near = near.join(people.select("fld", "key", F.col("family").alias("near"), F.col("middles").alias("others")), ["fld", "key", "near"])
    same = F.arrays_overlap("middles", "others")
    near = materialise(near.where(same | (F.size("middles") == 0) | (F.size("others") == 0)).withColumn("same", same))
    # Of two spellings in equally many strings the one with more neighbours is the right one.
    degree = near.groupBy("fld", "family").agg(F.count_distinct("near").alias("degree"))
    near = near.join(degree, ["fld", "family"]).join(degree.withColumnsRenamed({"family": "near", "degree": "near_degree"}), ["fld", "near"])
    righter = F.struct("near_weight", "near_degree", F.col("family").alias("c")) > F.struct(F.col("size").alias("near_weight"), F.col("degree").alias("near_degree"), F.col("near").alias("c"))
    near = near.where(righter).withColumn("sure", F.when(F.col("same") | ((F.col("size") <= 2) & (F.col("near_weight") >= 4 * F.col("size"))), F.col("near")))
    found = near.select("fld", F.explode("givens").alias("given"), "family", "near", "sure").groupBy("fld", "given", "family")
    best = found.agg(F.collect_set("near").alias("all"), F.collect_set("sure").alias("sure"))
    best = best.withColumn("right", F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("sure") == 1, F.col("sure")[0])).where("right is not null")
    best = materialise(best.select("fld", "given", "family", "right"))
    # The right spelling may itself be replaced where a slip was written twice; it is followed to its end.
    while True:
        on = best.select("fld", "given", F.col("family").alias("right"), F.col("right").alias("_end"))
        if best.join(on, ["fld", "given", "right"], "left_semi").isEmpty():
            break
        best = materialise(best.join(on, ["fld", "given", "right"], "left").select("fld", "given", "family", F.coalesce("_end", "right").alias("right")))
    return names.join(best, ["fld", "given", "family"], "left").withColumn("family", F.coalesce("right", "family")).drop("right")


def _people(forms: DataFrame) -> DataFrame:
    """(fld, family, given, middle, person) of each different (given, middle) form of a family that means one person.

    ``forms`` has fld, family, given, middle and, where given is a short form,
    ``formals``. A given name is one person's, unless full middle names differ.
    Short forms and initials are taken for the only person they fit, stand for
    themselves where they fit none, and are left out where they fit several.
    People are counted by what a form can ask for, so no family is gathered.
    """
    of = ["fld", "family"]
    long_middle = F.length("middle") > 1
    named = forms.where("length(given) > 1").select(*of, "given", "formals", F.coalesce(F.when(long_middle, F.col("middle")), F.lit("")).alias("m"))
    base = named.where("formals is null or m != ''").select(*of, "given", "m").distinct()
    # A short form with no full form in the family stands for itself.
    givens = base.select(*of, "given").distinct()
    others = named.where("formals is not null").select(*of, "given", "formals").distinct().join(givens, [*of, "given"], "left_anti")
    held = others.select(*of, "given", F.explode("formals").alias("formal")).join(givens.withColumnRenamed("given", "formal"), [*of, "formal"], "left_semi")
    alone = others.join(held, [*of, "given"], "left_anti").select(*of, "given", F.lit("").alias("m"))
    known = materialise(base.unionByName(alone))
    full = known.groupBy(*of, "given").agg(F.max("m").alias("_most"))
    people = known.join(full, [*of, "given"]).where("m != '' or _most = ''").select(*of, "given", "m")

    # What forms ask for: a given name or its initial, with any middle name, this one, this initial or none.
    asked = F.array(F.concat(F.lit("g"), F.col("given")), F.concat(F.lit("i"), F.substring("given", 1, 1)))
    middles = F.array_distinct(F.array(F.lit("*"), F.concat(F.lit("="), F.col("m")), F.concat(F.lit("0"), F.substring("m", 1, 1))))
    person = F.concat_ws("/", "given", "m")
    counted = people.select(*of, person.alias("person"), F.explode(asked).alias("ask"), middles.alias("_m")).select(*of, "person", "ask", F.explode("_m").alias("mid"))
    counted = counted.groupBy(*of, "ask", "mid").agg(F.count("*").alias("c"), F.min("person").alias("person"))

    of_form = [*of, "given", "middle"]
    rows = forms.join(full.select(*of, "given", F.lit(True).alias("_known")), [*of, "given"], "left")
    single = F.length("given") == 1
    look = F.when(single, F.array(F.concat(F.lit("i"), F.col("given")))).when(F.col("_known"), F.array(F.concat(F.lit("g"), F.col("given"))))
    look = look.otherwise(F.transform(F.coalesce("formals", F.array().cast("array<string>")), lambda x: F.concat(F.lit("g"), x)))
    given_middle = F.when(long_middle, F.array(F.concat(F.lit("="), F.col("middle")), F.lit("="))).otherwise(F.array(F.concat(F.lit("0"), F.col("middle")), F.lit("=")))
    mids = F.when(F.coalesce(F.length("middle"), F.lit(0)) == 0, F.array(F.lit("*"))).otherwise(given_middle)
    asks = rows.select(*of_form, F.explode_outer(look).alias("ask"), mids.alias("_m")).select(*of_form, "ask", F.explode("_m").alias("mid"))
    hits = asks.join(counted, [*of, "ask", "mid"], "left").groupBy(*of_form).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("hits"), F.min("person").alias("person"))
    own = F.when(single, F.concat("given", F.lit("?"))).otherwise(F.col("given"))
    return hits.where("hits < 2").select(*of_form, F.when(F.col("hits") == 1, F.col("person")).otherwise(own).alias("person"))


def people_of_names(df: DataFrame, fields: list[str], forms: DataFrame) -> DataFrame:
    """(``fld``, ``name``, ``family``, ``person``) of the different strings of ``fields`` that name a person.

    ``forms`` has formal and short_form of given names; further short forms are
    learned. Null, blank and placeholder values and single words name nobody
    and are left out. Equal persons are told by (fld, family, person); strings
    that may mean several people of a family are left out.
    """
    def folded(c: str, out: str):
        return F.translate(F.translate(F.lower(c), "أإآةى", "اااهي"), " ", "").alias(out)

    known = forms.where("formal is not null and short_form is not null").select(folded("formal", "formal"), folded("short_form", "short")).distinct()
    names = materialise(_corrected(materialise(_oriented(materialise(_parsed(df, fields)))), known))
    shorts = materialise(known.unionByName(_learned_forms(names)).where("formal != short").distinct())
    fixed = materialise(_family_slips(names, shorts))
    by_short = shorts.groupBy("short").agg(F.collect_set("formal").alias("formals"))
    distinct = materialise(fixed.select("fld", "family", "given", "middle").distinct().join(by_short, F.col("given") == F.col("short"), "left").drop("short"))
    people = _people(distinct)
    a, b = fixed.alias("a"), people.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("fld", "family", "given")] + [F.col("a.middle").eqNullSafe(F.col("b.middle"))]
    return a.join(b, same).select("a.fld", "a.name", "a.family", "b.person")


def same_person_pairs(df: DataFrame, fields: list[str], forms: DataFrame) -> DataFrame:
    """(``fld``, ``name_a``, ``name_b``): two different strings of a field, smaller first, that name the same person."""
    people = materialise(people_of_names(df, fields, forms))
    group = ["fld", "family", "person"]
    size = people.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    spread = pair_blocks(people, group, F.col("name"), size)
    keys = [*group, "_lo", "_hi"]
    a = spread.select(*keys, F.col("_part").alias("p"), F.col("name").alias("name_a"))
    b = spread.select(*keys, F.col("_part").alias("p2"), F.col("name").alias("name_b"))
    both = a.join(b, keys).where((F.col("name_a") < F.col("name_b")) & meets(F.col("p"), F.col("p2"), F.col("_lo"), F.col("_hi")))
    return both.select("fld", "name_a", "name_b").distinct()
