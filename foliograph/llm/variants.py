"""Variant spellings of names: weighted n-gram vectors, sparse cosine joins, average linkage.

A name is read into the part that tells entities apart (a person's surname, an
organisation's place) and the part it must agree on (given names, the kind of
organisation). The first part becomes a vector of character trigrams weighted by
rarity. Vectors meet in an inverted join inside their block (first initial, kind),
on prefix features only: trigrams are ordered from rare to common, and a vector's
prefix is what it needs so that the rest is shorter than the threshold. Two vectors
whose cosine reaches the threshold share a prefix feature, and no list is capped.
A pair that meets is weighed by the mistakes of typing between its stems, whose
number is bounded by the stems' length: two names of one ending stay apart however
rare its trigrams are. The bounds on lengths and places in the join follow from that
number, so they drop no pair that the weight keeps. Linked units form components;
inside each, the distinct names are grouped by average linkage over the weight times
the agreement of given names, where contradicting given names bar a merge. The more
names there are, the more stems of others stand one mistake apart, until most short
stems of a block are one component; so the linkage weighs linked groups only, and finds
them by keys.

Defined cases: null and blank names and names without letters belong to nothing;
equal names are always one entity; repeated rows of a record count once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm.names import edits, given_forms, organisation, person
from foliograph.operators.components import connected_components, groups_in_order
from foliograph.sources.store import settle

#: fixed values: accented letters and their plain forms, for counting words in the JVM
_ACCENTED, _PLAIN = "áàâäãåéèêëíìîïóòôöõøúùûüñçšžłýÿ", "aaaaaaeeeeiiiioooooouuuuncszlyy"

UNITS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("given", T.ArrayType(T.StringType())),
    ]
)


def frequent_words(names: DataFrame, share: float = 1 / 2000) -> frozenset[str]:
    """Words in more than `share` of the distinct names: given names. At most a few times 1 / share of them exist."""
    words = names.select(F.explode(F.array_distinct(F.split(F.translate(F.lower("name"), _ACCENTED, _PLAIN), r"[^\p{L}]+"))).alias("w")).where(F.length("w") > 1)
    least = max(8, int(names.count() * share))
    return frozenset(r[0] for r in words.groupBy("w").count().where(F.col("count") > least).select("w").collect())


def _read(given_words: frozenset[str]):
    """Rows of UNITS; a nickname stands in the block of each name it may be short for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, name in batch.itertuples(index=False):
                if kind == "person":
                    if got := person(name, given_words):
                        stem, given = got
                        blocks = {f[0] for f in given_forms(given[0])} if given else {""}
                        rows += [(kind, name, b, stem, list(given)) for b in sorted(blocks)]
                elif got := organisation(name):
                    rows.append((kind, name, got[1], got[0], []))
            yield pd.DataFrame(rows, columns=UNITS.names)

    return run


def trigrams(stem: str) -> dict[str, int]:
    """Distinct trigrams of a stem with its ends marked, with the place where each stands first."""
    text = f"^{stem}$"
    return {text[i : i + 3]: i for i in range(len(text) - 3, -1, -1)}


def trigram_weights(units: DataFrame) -> dict[tuple[str, str], float]:
    """Weight of each (kind, trigram) by its rarity among the distinct stems.

    Stems hold the letters a to z, blanks, hyphens and apostrophes only, so at most
    31 ** 3 trigrams per kind exist at any size of the data.
    """
    text = F.concat(F.lit("^"), F.col("stem"), F.lit("$"))
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    stems = units.where(F.length("stem") > 0).select("kind", "stem").distinct()
    counts = stems.select("kind", F.explode(F.array_distinct(cut)).alias("gram")).groupBy("kind", "gram").count().collect()
    total = {k: max(r["count"] for r in counts if r["kind"] == k) * 10 for k in {r["kind"] for r in counts}}
    return {(r["kind"], r["gram"]): math.sqrt(math.log(1 + total[r["kind"]] / r["count"])) for r in counts}


Vector = dict[str, tuple[float, int]]
#: a trigram is shared only if its places differ by no more than this
SHIFT = 2
#: from this length of the shorter stem on, two mistakes leave a name the same; below, only one does
LONG = 12
#: a stem of at least this length may be the other one broken off
STUMP = 7


def likeness(x: str, y: str, cos: float) -> float:
    """Weight of two stems from their cosine and the mistakes of typing between them.

    One mistake outweighs a low cosine (a short stem has few trigrams left). Two in a
    short stem count half, so that two misspellings of one name meet in the average with
    its right spelling but never by themselves. A stem that breaks off is like the whole
    one; others further apart are unlike at any cosine.
    """
    short = min(len(x), len(y))
    mistakes = edits(x, y, 2)
    if mistakes == 0:
        return 1.0
    if mistakes == 1:
        return max(cos, 0.9 if short > 4 else 0.75)
    if short >= STUMP and (x.startswith(y) or y.startswith(x)):
        return max(cos, 0.75)
    return (max(cos, 0.75) if short >= LONG else 0.5) if mistakes == 2 else 0.0


def vector(kind: str, stem: str, weights: dict[tuple[str, str], float]) -> Vector:
    """The unit vector of a stem: weight and place of each trigram."""
    raw = {g: (weights.get((kind, g), 3.0), i) for g, i in trigrams(stem).items()}
    norm = math.sqrt(sum(w * w for w, _ in raw.values())) or 1.0
    return {g: (w / norm, i) for g, (w, i) in raw.items()}


def cosine(x: Vector, y: Vector) -> float:
    """Cosine of two unit vectors over the trigrams that stand at about the same place."""
    return sum(w * y[g][0] for g, (w, i) in x.items() if g in y and abs(y[g][1] - i) <= SHIFT)


PREFIXES = T.StructType([T.StructField("unit", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("place", T.IntegerType())])
LINKS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("weight", T.DoubleType())])


def _parts(unit: str) -> tuple[str, str, str]:
    kind, block, stem = unit.split("|", 2)
    return kind, block, stem


MISTAKE_KEYS = T.StructType([T.StructField("unit", T.StringType()), T.StructField("key", T.StringType()), T.StructField("stump", T.BooleanType())])


def _mistake_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MISTAKE_KEYS: a unit and it without any one letter, of which two stems with one mistake between them share one; and its beginnings."""
    for batch in batches:
        rows = []
        for unit in batch["unit"]:
            stem = _parts(unit)[2]
            head = unit[: len(unit) - len(stem)]
            rows += [(unit, head + k, False) for k in {stem, *(stem[:i] + stem[i + 1 :] for i in range(len(stem)))}]
            rows += [(unit, head + stem[:i], True) for i in range(STUMP, len(stem))]
        yield pd.DataFrame(rows, columns=MISTAKE_KEYS.names)


def _prefixes(shared, threshold: float):
    """One row per prefix feature: trigrams from rare to common until the rest is shorter than the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for batch in batches:
            rows = []
            for unit in batch["unit"]:
                kind, block, stem = _parts(unit)
                rest = 1.0
                order = sorted(vector(kind, stem, weights).items(), key=lambda p: (-weights.get((kind, p[0]), 3.0), p[0]))
                for gram, (w, place) in order:
                    if rest < threshold * threshold:
                        break
                    rows.append((unit, f"{kind[0]}{block}|{gram}", place))
                    rest -= w * w
            yield pd.DataFrame(rows, columns=PREFIXES.names)

    return run


def _verify(shared, threshold: float, least: float):
    """LINKS of the candidate pairs that reach the threshold and weigh at least `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value

        @lru_cache(maxsize=50_000)
        def known(unit: str) -> Vector:
            kind, _, stem = _parts(unit)
            return vector(kind, stem, weights)

        for batch in batches:
            rows = []
            for a, b in zip(batch["a"], batch["b"]):
                c = cosine(known(a), known(b))
                if c >= threshold and (w := likeness(_parts(a)[2], _parts(b)[2], c)) >= least:
                    rows.append((a, b, w))
            yield pd.DataFrame(rows, columns=LINKS.names)

    return run


def similar_units(units: DataFrame, shared, threshold: float, least: float = 0.55) -> DataFrame:
    """LINKS between units (kind, block, stem) of one block whose stems' cosine reaches the threshold and whose weight reaches `least`."""
    distinct = settle(units.where(F.length("stem") > 0).select(F.concat_ws("|", "kind", "block", "stem").alias("unit")).distinct())
    stem = F.substring_index("unit", "|", -1)
    keys = distinct.mapInPandas(_mistake_keys, MISTAKE_KEYS)
    whole = keys.where(~F.col("stump")).select("unit", "key")
    once = whole.toDF("a", "key").join(whole.toDF("b", "key").hint("merge"), "key").where(F.col("a") < F.col("b")).select("a", "b")
    begun = keys.where("stump").select(F.col("unit").alias("a"), "key").join(distinct.select(F.col("unit").alias("b")).hint("merge"), F.col("key") == F.col("b"))
    begun = begun.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # two mistakes leave only long stems the same; each changes the length and moves the rest by one place at most
    prefixes = settle(distinct.where(F.length(stem) >= LONG).mapInPandas(_prefixes(shared, threshold), PREFIXES))
    here = prefixes.select(F.col("unit").alias("a"), "feature", "place", stem.alias("x"))
    other = prefixes.select(F.col("unit").alias("b"), "feature", F.col("place").alias("there"), stem.alias("y"))
    apart = F.greatest(F.abs(F.col("place") - F.col("there")), F.abs(F.length("x") - F.length("y")))
    # a swap of neighbours is one mistake and two edits
    twice = here.join(other, "feature").where((F.col("a") < F.col("b")) & (apart <= 2) & (F.levenshtein("x", "y", 4) >= 0)).select("a", "b")
    pairs = once.unionByName(begun).unionByName(twice).distinct()
    return settle(pairs.mapInPandas(_verify(shared, threshold, least), LINKS))


def first_letter_links(units: DataFrame, unit: Column) -> DataFrame:
    """(a, b): units of one person's stem whose given names differ in their first two letters only (lost, added, changed or swapped).

    Such a mistake puts a name into another block. Each group is a star around its smallest unit.
    """
    first = F.col("given")[0]
    swapped = F.concat(F.array_join(F.array_sort(F.split(F.substring(first, 1, 2), "")), ""), F.substring(first, 3, 99))
    keys = F.array_distinct(F.array(first, F.substring(first, 2, 99), swapped))
    rows = units.where((F.col("kind") == "person") & (F.length(first) > 3)).select("stem", unit.alias("u"), F.explode(keys).alias("k")).distinct()
    groups = rows.groupBy("stem", "k").agg(F.sort_array(F.collect_set("u")).alias("us")).where(F.size("us") > 1)
    return groups.select(F.explode("us").alias("a"), F.col("us")[0].alias("b")).distinct()


@lru_cache(maxsize=200_000)
def _first_agreement(x: str, y: str, common: frozenset[str]) -> float:
    """1 for the same given name (short forms and misspellings included), 0.85 for a fitting initial, below 0 for another name.

    Two names that are both `common` are no misspellings of each other.
    """
    if x == y:
        return 1.0
    if len(x) > 1 and len(y) > 1:
        if x in common and y in common:
            return 1.0 if given_forms(x) & given_forms(y) else -3.0
        near = any(edits(f, g, 2) <= (1 if min(len(f), len(g)) < 6 else 2) for f in given_forms(x) for g in given_forms(y))
        return 1.0 if near else -3.0
    return 0.85 if {f[0] for f in given_forms(x)} & {f[0] for f in given_forms(y)} else -3.0


def given_agreement(a: tuple[str, ...], b: tuple[str, ...], common: frozenset[str] = frozenset()) -> float:
    """How well two lists of given names or initials agree; what only one of them has further does not count."""
    if not a or not b:
        return 0.6
    x, y = "".join(w for w in a if len(w) > 1), "".join(w for w in b if len(w) > 1)
    if min(len(x), len(y)) > 4 and edits(x, y, 1) <= 1:  # a hyphen lost or moved
        return 1.0
    score = _first_agreement(a[0], b[0], common)
    if score < 0 or len(a) == 1 or len(b) == 1:
        return score
    left, right = list(a[1:]), list(b[1:])
    for word in a[1:]:
        near = next((w for w in right if w == word or len(w) > 3 and len(word) > 3 and edits(w, word, 2) <= 2), None)
        if near:
            left.remove(word)
            right.remove(near)
    if left and right and left[0][0] != right[0][0]:
        return min(score, -0.5)
    if left and right and len(left[0]) > 1 and len(right[0]) > 1:
        return min(score, -0.5)
    return score


def linkage(n: int, similarity: Callable[[int, int], float], links: list[tuple[int, int]], least: float) -> list[int]:
    """Group numbers of 0..n-1 from merging, again and again, the two groups of highest average similarity.

    links: all pairs whose similarity reaches `least`. Groups whose average reaches it hold
    such a pair, so only they are weighed, and no matrix of all pairs is held.
    """
    label, at, parts, size = list(range(n)), list(range(n)), {}, [1] * n
    near: list[set[int]] = [set() for _ in range(n)]
    known: dict[tuple[int, int], float] = {}

    def total(p: int, q: int) -> float:
        """Sum over the pairs of two groups; a group's number tells when it was made."""
        p, q = max(p, q), min(p, q)
        if (p, q) not in known:
            known[p, q] = total(parts[p][0], q) + total(parts[p][1], q) if p in parts else similarity(p, q)
        return known[p, q]

    heap: list[tuple[float, int, int, int, int]] = []

    def weigh(i: int, j: int) -> None:
        i, j = min(i, j), max(i, j)
        mean = total(at[i], at[j]) / (size[i] * size[j])
        if mean >= least:
            heapq.heappush(heap, (-mean, i, j, at[i], at[j]))

    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    for i in range(n):
        for j in near[i]:
            if i < j:
                weigh(i, j)
    made = n
    while heap:
        _, i, j, p, q = heapq.heappop(heap)
        if at[i] != p or at[j] != q:
            continue
        parts[made], at[i], at[j] = (p, q), made, -1
        made += 1
        size[i] += size[j]
        label[j] = i
        near[i] = (near[i] | near[j]) - {i, j}
        for x in near[j]:
            near[x].discard(j)
        near[j] = set()
        for x in near[i]:
            near[x].add(i)
            weigh(i, x)
    for i in range(n):  # a group is named by its first member, which stands before the others
        label[i] = label[label[i]]
    return label


def average_linkage(similarity: np.ndarray, least: float) -> list[int]:
    """`linkage` over a matrix of all pairs."""
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(similarity >= least, 1)))]
    return linkage(len(similarity), lambda i, j: float(similarity[i, j]), links, least)


def near_stems(stems: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i > j, of all stems with one mistake between them, of long ones with two, and of those that break off; of some others too.

    A mistake is made good by leaving out one letter on either side, so such stems share a
    key that lacks one letter or two.
    """
    keys: dict[str, list[int]] = {}
    for i, stem in enumerate(stems):
        short = {stem[:x] + stem[x + 1 :] for x in range(len(stem))} | {stem}
        if len(stem) >= LONG:
            short |= {s[:x] + s[x + 1 :] for s in short for x in range(len(s))}
        for key in short:
            keys.setdefault(key, []).append(i)
    where = {stem: i for i, stem in enumerate(stems)}
    pairs = {(held[y], held[x]) for held in keys.values() for y in range(len(held)) for x in range(y)}
    for i, stem in enumerate(stems):
        pairs |= {(max(i, j), min(i, j)) for x in range(STUMP, len(stem)) if (j := where.get(stem[:x])) is not None}
    yield from sorted(pairs)


#: from this number of forms on, those that may be alike are looked up by keys
FEW = 40


def form_links(forms: list[tuple], similarity, least: float) -> list[tuple[int, int]]:
    """(i, j), i > j, of all forms (stem, given) whose similarity reaches `least`, which two forms of unlike stems never do."""
    if len(forms) < FEW:
        may = ((i, j) for i in range(len(forms)) for j in range(i))
    else:
        of: dict[str, list[int]] = {}
        for i, (stem, _) in enumerate(forms):
            of.setdefault(stem, []).append(i)
        stems = list(of)
        own = ((y, x) for held in of.values() for n, y in enumerate(held) for x in held[:n])
        other = ((max(x, y), min(x, y)) for i, j in near_stems(stems) for x in of[stems[i]] for y in of[stems[j]])
        may = chain(own, other)
    return [(i, j) for i, j in may if similarity(forms[i], forms[j]) >= least]


def group_forms(forms: list[tuple], similarity, least: float) -> list[int]:
    """Group numbers of `forms` (stem, given) by average linkage."""
    return linkage(len(forms), lambda i, j: similarity(forms[i], forms[j]), form_links(forms, similarity, least), least)


CLUSTERS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("entity", T.StringType())])


def _cluster(shared, common: frozenset[str], least: float):
    """CLUSTERS from rows (component, kind, name, stem, given) sorted by component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        out: list[tuple] = []
        for component, d in groups_in_order(batches, "component"):
            names: dict[str, tuple] = {}
            kind = d["kind"].iloc[0]
            for name, stem, given in zip(d["name"], d["stem"], d["given"]):
                names.setdefault(name, (stem, tuple(given)))
            forms = sorted(set(names.values()))
            vectors = lru_cache(maxsize=20_000)(lambda stem: vector(kind, stem, weights))

            @lru_cache(maxsize=100_000)
            def stems(x: str, y: str) -> float:
                return 1.0 if x == y else likeness(x, y, cosine(vectors(x), vectors(y)))

            def alike(x: tuple, y: tuple) -> float:
                s = stems(x[0], y[0])
                return s * given_agreement(x[1], y[1], common) if s and kind == "person" else s

            label = group_forms(forms, alike, least)
            entity = {form: f"{component}#{group}" for form, group in zip(forms, label)}
            out += [(kind, name, entity[form]) for name, form in names.items()]
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=CLUSTERS.names)
                out = []
        yield pd.DataFrame(out, columns=CLUSTERS.names)

    return run


def group_variants(records: DataFrame, threshold: float = 0.30, least: float = 0.55) -> DataFrame:
    """(rec, entity) of every readable record of `records` (rec, kind, name); kind is person or organisation."""
    rows = records.where(F.col("rec").isNotNull() & (F.length(F.trim("name")) > 0)).select("rec", "kind", "name").distinct()
    names = rows.select("kind", "name").distinct()
    given = frequent_words(names.where(F.col("kind") == "person").select("name"))
    units = settle(names.mapInPandas(_read(given), UNITS))
    unit = F.concat_ws("|", "kind", "block", "stem")
    shared = units.sparkSession.sparkContext.broadcast(trigram_weights(units))
    links = similar_units(units, shared, threshold, least).select("a", "b").union(first_letter_links(units, unit))
    # units of one name (a nickname's blocks) belong together, and every unit is there at least alone
    own = units.groupBy("kind", "name").agg(F.sort_array(F.collect_set(unit)).alias("u")).select(F.explode("u").alias("a"), F.col("u")[0].alias("b"))
    components = connected_components(links.union(own), "a", "b")
    placed = units.withColumn("unit", unit).join(components, F.col("unit") == F.col("node")).select("component", "kind", "name", "stem", "given")
    clusters = placed.repartition("component").sortWithinPartitions("component", "name").mapInPandas(_cluster(shared, given, least), CLUSTERS)
    return rows.join(clusters, ["kind", "name"]).select("rec", "entity")


def entity_pairs(members: DataFrame, part: int = 2000) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, of records of one entity; entities above `part` records are shared by several tasks."""
    sized = members.groupBy("entity").agg(F.ceil(F.count("*") / part).cast("int").alias("s")).where(F.col("s") > 1)
    known = members.join(sized, "entity", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    left = known.select("entity", F.col("rec").alias("rec_a"), F.pmod(F.xxhash64("rec"), F.col("s")).cast("int").alias("salt"))
    right = known.select("entity", F.col("rec").alias("rec_b"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    return left.join(right, ["entity", "salt"]).where(F.col("rec_a") < F.col("rec_b")).select("rec_a", "rec_b")
