import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.llm.boosting import Boosted
from foliograph.llm.harmful import LONGEST, _windows, fold, score_documents, train, units
from foliograph.llm.linkage import _near, match_citations, name_mark, names_fit, title_similarity, year_of
from foliograph.llm.names import edits, organisation, person
from foliograph.llm.one_ranking import combine_scores, far_shares, loadings, normal_score, top_items, without_far
from foliograph.llm.scans import _alike, defects, examine, learn, middle, page_part, read_lines, repair
from foliograph.llm.variants import _mistake_keys, average_linkage, entity_pairs, given_agreement, group_forms, group_variants, similar_units


def test_one_ranking(spark):
    rng = random.Random(3)
    rows = []
    for q, scale in (("q1", 1.0), ("q2", 1e6)):
        for i in range(40):
            good = i < 10
            rows.append((q, f"n{i:02d}", scale * (rng.random() + good), rng.random() * 1e-3 + good * 1e-3, -5 + rng.random() + good, 1))
    rows += [rows[0], ("q1", "none", None, float("nan"), None, 1), ("q1", "one", None, 2e-3, None, 1)]
    df = spark.createDataFrame(rows, "q string, n string, a double, b double, c double, at int")
    got = combine_scores(df, group="q", item="n", scores={"a": 1, "b": 1, "c": 1}, latest="at")
    top = {(r.q, r.n) for r in top_items(got, group="q", item="n", k=10).collect()}
    assert sum(n < "n10" for _, n in top) >= 18
    assert got.where("n = 'none'").first().projection is None and got.count() == 82
    down = combine_scores(df.selectExpr("q", "n", "-a AS a", "-b AS b", "-c AS c", "at"), group="q", item="n", scores={"a": -1, "b": -1, "c": -1}, latest="at")
    assert {tuple(r) for r in down.collect()} == {tuple(r) for r in got.collect()}
    assert combine_scores(df.limit(0), group="q", item="n", scores={"a": 1, "b": 1}, latest="at").count() == 0


def test_far_values_say_nothing(spark):
    rng = random.Random(5)
    rows = [("q", f"n{i:02d}", rng.random() + (i < 10), rng.random() + (i < 10), rng.random() + (i < 10), 1) for i in range(40)]
    for i in (20, 25, 30, 35):  # poor items with one score far above, or below, all others
        rows[i] = (*rows[i][:2], 1e4 * (i if i < 35 else -i), 0.3, 0.3, 1)
    rows += [("few", f"n{i}", 10.0**i, 1.0, 1.0, 1) for i in range(9)] + [("flat", f"n{i:02d}", float(i == 3), 1.0, 1.0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "q string, n string, a double, b double, c double, at int")
    kept = without_far(df, "q", ["a", "b", "c"])
    assert {(r.q, r.n) for r in kept.where("a IS NULL").collect()} == {("q", "n20"), ("q", "n25"), ("q", "n30"), ("q", "n35")}
    assert kept.where("b IS NULL OR c IS NULL").count() == 0 and kept.count() == len(rows)
    got = combine_scores(df.where("q = 'q'"), group="q", item="n", scores={"a": 1, "b": 1, "c": 1}, latest="at")
    assert {r.n for r in top_items(got, group="q", item="n", k=10).collect()} == {f"n{i:02d}" for i in range(10)}
    value = {r.n: r.projection for r in got.collect()}
    assert all(value[f"n{i}"] < 0.5 for i in (20, 25, 30, 35))


def test_far_values_among_real_ones_are_told_by_the_other_scores(spark):
    rng = random.Random(7)
    rows = []
    for q in range(60):
        for i in range(60):
            z = rng.gauss(0, 1) + 3 * (i < 10)
            a, b, c = (z + rng.gauss(0, 0.7) for _ in range(3))
            # two poor items a query stand among the best real scores, which spread over powers of ten
            a = np.exp(2 * a) if i < 58 else np.exp(2 * rng.uniform(4.5, 5.5))
            rows.append((f"q{q:02d}", f"n{(i * 37 + q) % 60:02d}", i < 10, i >= 58, float(a), b, c, 1))
    df = spark.createDataFrame(rows, "q string, n string, good boolean, far boolean, a double, b double, c double, at int")
    got = combine_scores(df, group="q", item="n", scores={"a": 1, "b": 1, "c": 1}, latest="at")
    places = top_items(got, group="q", item="n", k=60).join(df, ["q", "n"])
    far, poor = (places.where(c).agg(F.avg("place")).first()[0] for c in ("far", "NOT far AND NOT good"))
    assert poor - far < 2  # 3.8 as ranks without a look at the other scores
    assert places.where("place <= 10 AND good").count() >= 490
    plain = df.select("q", "n", *[normal_score((F.percent_rank().over(W.partitionBy("q").orderBy(s)) * 59 + 0.5) / 60).alias(s) for s in "abc"])
    parts = plain.join(df.select("q", "n"), ["q", "n"]).select("*", *[F.ntile(40).over(W.partitionBy("q").orderBy(s)).alias(f"t_{s}") for s in "abc"])
    shares = far_shares(parts.select("*", *[(F.col(f"t_{s}") - 1).alias(f"_part_{s}") for s in "abc"]), ["a", "b", "c"])
    assert shares[0, -1] > 0.3 and shares[1:].max() < 0.2 and shares[:, 10:30].max() < 0.2
    assert far_shares(parts.select("*", *[(F.col(f"t_{s}") - 1).alias(f"_part_{s}") for s in "abc"]).limit(0), ["a", "b", "c"]).max() == 0


def test_a_missing_score_stands_with_what_the_others_let_expect(spark):
    rng = random.Random(2)
    rows = [("q", f"n{i:02d}", i + rng.gauss(0, 15), i + rng.gauss(0, 15), 1) for i in range(60)] + [("q", "alone", 200.0, None, 1), ("q", "both", 199.0, 100.0, 1)]
    df = spark.createDataFrame(rows, "q string, n string, a double, b double, at int")
    value = {r.n: r.projection for r in combine_scores(df, group="q", item="n", scores={"a": 1, "b": 1}, latest="at").collect()}
    # the best of one score, whose other is not known, stands below one that is high in both
    assert value["n30"] < value["alone"] < value["both"]
    same = spark.createDataFrame([("q", str(i), float(i), float(i), 1) for i in range(20)] + [("q", "x", 7.0, None, 1)], "q string, n string, a double, b double, at int")
    order = [r.n for r in combine_scores(same, group="q", item="n", scores={"a": 1, "b": 1}, latest="at").orderBy("projection").collect()]
    assert [n for n in order if n != "x"] == [str(i) for i in range(20)] and abs(order.index("x") - 7) <= 1


def test_loadings():
    assert np.allclose(loadings(np.eye(3) * 0.4 + 0.6, [1, 1, 1]), 1 / 3**0.5)
    assert (loadings(np.array([[1, -0.5], [-0.5, 1]]), [1, -1]) * [1, -1] > 0).all()


@pytest.mark.parametrize(
    "name, want",
    [
        ("Dowl, Ann B.", ("dowl", ("ann", "b"))),
        ("Ann B. Dowl", ("dowl", ("ann", "b"))),
        ("GREENSON Ann", ("greenson", ("ann",))),
        ("Greenson AB", ("greenson", ("a", "b"))),
        ("Prof. Greenson, Ann, PhD", ("greenson", ("ann",))),
        ("Müller-Lüd, Zoë¹", ("lud", ("zoe", "muller"))),
        ("Greenson DR", ("greenson", ("d", "r"))),
        ("12", None),
        (None, None),
    ],
)
def test_person(name, want):
    assert person(name) == want


def test_organisation():
    want = ("gulden", "technical university")
    for name in ("Technical University of Gulden", "TU Gulden", "Dept. of Physics, Gulden Tech. Univ., Halvia", "(2) Technische Universität Gulden", "GULDEN TECHNICAL UNIVERSITY"):
        assert organisation(name) == want, name
    assert organisation("Gulden Medical College") != want and organisation("") is None


def test_edits():
    assert edits("gulden", "gudlen", 1) == 1 and edits("abc", "xyz", 2) == 3 and edits("a", "a", 1) == 0


def test_given_names():
    assert given_agreement(("margaret",), ("peggy",)) == 1 and given_agreement(("hae", "mi"), ("haemi",)) == 1
    assert given_agreement(("ann",), ("bob",)) < 0 < given_agreement(("a",), ("ann", "b"))


def test_average_linkage():
    m = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    a, b, c = average_linkage(m, 0.5)
    assert a == b != c


def test_linkage_weighs_linked_forms_only():
    """A chain of short stems, each a mistake away from the next, as many names of one initial make it."""
    stems, letters = [], "abcdefgh"
    for i in range(200):
        letters = letters[: i % 8] + chr((ord(letters[i % 8]) - 96) % 26 + 97) + letters[i % 8 + 1 :]
        stems.append(letters)
    forms = [(s, (g,)) for s in stems for g in ("e", "emma")]
    asked = []

    def alike(x, y):
        asked.append((x, y))
        return float(x[0] == y[0]) or (0.56 if sum(a != b for a, b in zip(x[0], y[0])) == 1 else 0.0)

    label = group_forms(forms, alike, 0.55)
    assert len(asked) < 0.1 * len(forms) ** 2 / 2
    of = dict(zip(forms, label))
    assert all(of[s, ("e",)] == of[s, ("emma",)] for s in stems) and 1 < len(set(label)) <= len(stems)


def test_linkage_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        m = np.triu(rng.choice([-3, 0, 0.5, 0.56, 0.765, 0.9, 1], size=(n, n)), 1)
        m = m + m.T + np.eye(n)
        sums, size, label = m.copy(), np.ones(n), list(range(n))
        np.fill_diagonal(sums, -np.inf)
        while True:
            i, j = sorted(divmod(int((mean := sums / np.outer(size, size)).argmax()), n))
            if mean[i, j] < 0.55:
                break
            sums[i] += sums[j]
            sums[:, i] = sums[i]
            sums[i, i], size[i] = -np.inf, size[i] + size[j]
            sums[j] = sums[:, j] = -np.inf
            label = [i if x == j else x for x in label]
        assert average_linkage(m, 0.55) == label


def test_variants(spark):
    names = ["Deborah Grünsomtander", "Grunsomtander, D.", "Deb Grünsomtander", "Deborah Grünsontander", "Dario Zulchebambski", "Zulchebambski DR", "Dario R. Zulchebmabski", "Samuel Zulchebambski", "  ", None, "77"]
    rows = [(f"r{i:02d}", "person", n) for i, n in enumerate(names)] + [("r00", "person", names[0])]
    orgs = ["TU Gulden", "Gulden Technical University, Halvia", "Gulden Medical College"]
    rows += [(f"o{i}", "organisation", n) for i, n in enumerate(orgs)]
    members = group_variants(spark.createDataFrame(rows, "rec string, kind string, name string"))
    got = {tuple(r) for r in entity_pairs(members).collect()}
    same = lambda *ids: {(a, b) for a in ids for b in ids if a < b}
    assert got == same("r00", "r01", "r02", "r03") | same("r04", "r05", "r06") | {("o0", "o1")}
    assert {tuple(r) for r in entity_pairs(members, part=1).collect()} == got
    assert group_variants(spark.createDataFrame([], "rec string, kind string, name string")).count() == 0


def test_stems_of_unlike_lengths(spark):
    stems = ["grunsomtander", "grunsomtan", "zulcheband"]
    units = spark.createDataFrame([("person", "d", s) for s in stems], "kind string, block string, stem string")
    shared = spark.sparkContext.broadcast({})
    got = {(r[0].rsplit("|")[-1], r[1].rsplit("|")[-1]) for r in similar_units(units, shared, 0.4).collect()}
    assert {tuple(sorted(g)) for g in got} == {("grunsomtan", "grunsomtander")}


def test_only_stems_with_a_mistake_share_a_key():
    units = [f"person|a|{s}" for s in ("klegrudine", "klegrudne", "klegurdine", "klegrudyne", "klegrud", "klegramine", "mirziarine")]
    keys = pd.concat(_mistake_keys(iter([pd.DataFrame({"unit": units})])))
    whole = keys[~keys["stump"]].groupby("unit")["key"].agg(set)
    assert [u.split("|")[2] for u in units if whole[u] & whole[units[0]]] == ["klegrudine", "klegrudne", "klegurdine", "klegrudyne"]
    assert units[4] in set(keys[keys["stump"] & (keys["unit"] == units[0])]["key"])


def test_linkage(spark):
    papers = [
        ("p1", "Masked Page Graphs for River Gauge Charts", "2019", ["Ann Greenson", "Bob Whitfield"]),
        ("p2", "Masked Page Graphs for River Gauge Charts Revisited", "2021", ["Ann Greenson"]),
        ("p3", "Reading Quarry Accounts with Sparse Legend Graphs", None, ["Lumkan, Cy"]),
        ("p4", None, "2020", None),
    ]
    cites = [
        ("c1", "MASKED PAGE GRAPHS FOR RIVER GAUGE CHARTS", "(2019)", "Greenson, A.; Whitfield, B."),
        ("c2", "Masked Pgae Graphs for River Gauge Charts revisited", "2021a", "A. Greenson"),
        ("c3", "Reading Quarry Accounts with Sparse…", None, "Lumkan C, et al."),
        ("c4", "Masked Page Graphs for River Gauge Charts", "2003", "Zeilman, Q."),
        ("c5", None, "2019", "Greenson, A."),
        ("c6", "", None, None),
        ("c1", "MASKED PAGE GRAPHS FOR RIVER GAUGE CHARTS", "(2019)", "Greenson, A.; Whitfield, B."),
    ]
    c = spark.createDataFrame(cites, "key string, title string, year string, authors string")
    p = spark.createDataFrame(papers, "key string, title string, year string, authors array<string>")
    got = {r.key: r.paper for r in match_citations(c, p).collect()}
    assert got == {"c1": "p1", "c2": "p2", "c3": "p3"}
    assert match_citations(c.limit(0), p).count() == 0 and match_citations(c, p.limit(0)).count() == 0
    assert year_of("'09") == 2009 and year_of("x") is None
    assert title_similarity(["a"], ["a"]) == (1.0, 1.0)


def test_linkage_titles_of_all(spark):
    # c1's only key leads to the wrong paper q2; c2 shares one triple each with q3 and q5; c3 shares no triple, and keys only of its short words
    papers = [
        ("q1", "From Bibliography to Folio: Frozen Heading Recovery with Visiamero", "2022", ["Tarek Daltdan"]),
        ("q2", "Recovery of Harbour Maps", "2015", ["Tarek Daltadan"]),
        ("q3", "Ledger Plates Joined under Quarry Weather Sings Read", "2018", ["Mira Olsenby"]),
        ("q4", "Cartographers Tar Nets Archaeologists Oil Rope Bibliographers Silk Jute", "2011", ["Ivo Brannick"]),
        ("q5", "Weather Signs Read by Harbour Pilots", "2004", ["Una Teld"]),
    ]
    cites = [
        ("c1", "From Bibliography to Folio: Frozen Heading Recovery with Visiamero", "2022", "Daltadan, T."),
        ("c2", "Ledger Plates Joined under Quarrry Weather Signs Read", "2018", None),
        ("c3", "Kartographers Tar Nets Srchaeologists Oil Rope Vibliographers Silk Jute", "2011", "Brannick, I."),
    ]
    c = spark.createDataFrame(cites, "key string, title string, year string, authors string")
    p = spark.createDataFrame(papers, "key string, title string, year string, authors array<string>")
    assert {r.key: r.paper for r in match_citations(c, p).collect()} == {"c1": "q1", "c2": "q3", "c3": "q4"}


def test_name_marks(spark):
    pairs = [("dowl", "dowl"), ("dowl", "dowm"), ("dowl", "dwol"), ("grunewald", "gruenwalt"), ("o-hara", "ohara"), ("ze", "ze"), ("dowl", "brixton"), ("grunewald", "pelhasdander")]
    rows = spark.createDataFrame([(x, y, [name_mark(x)], [name_mark("zzzz"), name_mark(y)]) for x, y in pairs], "x string, y string, a array<int>, b array<int>")
    got = {(r.x, r.y): r.fit for r in rows.select("x", "y", names_fit(F.col("a"), F.col("b")).alias("fit")).collect()}
    assert all(got[p] for p in pairs[:6]) and not any(got[p] for p in pairs[6:])
    assert all(got[p] for p in pairs if p[0] == p[1] or _near(*p))
    empty = spark.createDataFrame([([], [1]), ([1], [])], "a array<int>, b array<int>")
    assert all(r[0] for r in empty.select(names_fit(F.col("a"), F.col("b"))).collect())


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = Boosted().fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert Boosted().fit(x[:5], np.zeros(5)).predict(x[:2]).max() < 0.5


HARMLESS = ["The {} reader keeps drift within two points.", "Costs grow with the number of {} pairs.", "I read the part on {} twice and still do not see why drift matters."]
HARMFUL = ["What a miserable moron you are, {} clown.", "You worthless idiot, your {} code is garbage."]
THINGS = "page graph chart index table folio node edge plate ledger".split()


def test_harmful(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        lines = [rng.choice(HARMLESS).format(rng.choice(THINGS)) for _ in range(4)]
        if i % 4 == 0:
            lines[rng.randrange(4)] = rng.choice(HARMFUL).format(rng.choice(THINGS))
        texts.append("\n".join(lines))
        labels.append(i % 4 == 0 if rng.random() > 0.03 else i % 4 != 0)
    model = train(texts[:300], np.array(labels[:300], float))
    truth = np.array([i % 4 == 0 for i in range(300, 400)])
    assert ((model.score(texts[300:]) >= model.threshold) == truth).mean() > 0.95
    rows = [(1, "The page reader keeps drift within two points.", "x", 0.1), (2, None, "x", 0.2), (3, "", None, 0.3), (4, "wh@t a m1serable m0r0n you are, page clown. " * 500, "y", 0.4)]
    got = {r.doc_id: r.harmful for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), model, key="doc_id", text="text", keep=["source"]).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
    assert train(["a"], np.array([0.0])).score(["a"])[0] < 0.5
    assert fold("M0r0nnnnn, 12 tim3s") == fold("moron, 9 times") and units("  ") == []


@pytest.mark.parametrize("unit", ["".join(chr(0x4E00 + i) for i in range(900)), "ab " * 40 + "".join(chr(0x4E00 + i) for i in range(417)), "".join(chr(0x4E00 + i) for i in range(150)) + "".join(f" v{i:03d}" for i in range(30)), " ".join(f"w{i:04d}" for i in range(70))])
def test_windows_cover_the_unit(unit):
    got = _windows(unit)
    reached = 0
    for w in got:
        starts = [m.start() for m in re.finditer(re.escape(w), unit)]
        assert starts and len(w) <= LONGEST and starts[0] <= reached
        reached = max(reached, max(s for s in starts if s <= reached) + len(w))
    assert reached == len(unit)


SAMPLES = [
    ("The page reader was trai-\nned on quarry accounts.\n– 3 –\nCosts grow with th¢ number.", "The page reader was trained on quarry accounts. Costs grow with the number."),
    ("A plain node graph was tested over the harbour ledg¬\ners and the river charts.\nLumkan et al.\nEdges are pruncd.", "A plain node graph was tested over the harbour ledgers and the river charts. Edges are pruned."),
] * 12


def test_scans(spark):
    models = learn(SAMPLES)
    text = "We rank the riode edges over the quarry acco-\nunts and the page graphs over the quarry\nPage 3\nLumkan et al.\naccounts and the harbour ledgers."
    lexicon = {w: 9 for w in "we rank the node edges over quarry accounts and harbour ledgers page graphs".split()}
    reading = read_lines(text, "Page Graphs", frozenset(), lexicon, models)
    assert reading.defects == {"hyphen", "header", "page_no"} and "accounts" in reading.text
    assert page_part("Page 3 of 9") == ("Page 3 of 9", "") and page_part("Lumkan et al.    9") == ("9", "Lumkan et al.") and page_part("n = 48")[0] == ""
    clean = [(" ".join(lexicon),)] * 5 + [(None,), ("",)]
    rows = [("t", "1", text, "Page Graphs for Quarry"), ("t", "2", None, None), ("t", "3", " ", "x"), ("t", "4", "We rank the node edges.", None), ("t", "5", "PAGE GRAPHS FOR QUARRY", "Page Graphs for Quarry")]
    scanned = spark.createDataFrame(rows, "src_table string, rec_id string, text string, title string")
    samples = spark.createDataFrame(SAMPLES, "raw_text string, clean_text string")
    scans = examine(scanned, spark.createDataFrame(clean, "text string"), samples, spark.createDataFrame([("V",)], "name string"))
    got = {(r.rec_id, r.defect) for r in defects(scans).collect()}
    assert got == {("1", "hyphen"), ("1", "header"), ("1", "page_no"), ("1", "misread"), ("5", "header")}
    texts = {r.rec_id: r.text for r in repair(scanned, scans).collect()}
    assert texts["1"] == "We rank the node edges over the quarry accounts and the page graphs over the quarry accounts and the harbour ledgers." and texts["2"] is None


def test_unlike_words_are_not_paired(spark):
    words = ["routing", "rnuting", "r outing", "routers", "outings", "boating", "raiding", "strong", "matrices", "matnx"]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words if " " not in y], "token string, word string")
    got = {tuple(r) for r in _alike(pairs).collect()}
    near = {(x, y) for x, y in pairs.collect() if abs(len(x.replace(" ", "")) - len(y)) <= 1}
    assert {p for p in near if all(len(m) <= 3 for m in middle(*p))} <= got < near


def test_scans_rare_words(spark):
    # 2.4 million words: a word that stands there three times holds less than 2e-6 of them
    plain = "we rank the node edges over quarry accounts and harbour ledgers for page graphs "
    clean = spark.range(40).select(F.repeat(F.lit(plain), 4300).alias("text")).union(spark.createDataFrame([("we rank visiamero and zulcheband over lumkanvik-gauges",)] * 3, "text string"))
    rows = [("t", "1", "We rank the visiarnero edges.", None), ("t", "2", "We rank visiamero and zulche band.", None), ("t", "3", "We rank visia-\nmero and lumkanvik-\ngauges over quarry.", None)]
    scanned = spark.createDataFrame(rows, "src_table string, rec_id string, text string, title string")
    scans = examine(scanned, clean, spark.createDataFrame(SAMPLES, "raw_text string, clean_text string"), spark.createDataFrame([("V",)], "name string"))
    tokens = {(r.rec_id, r.token) for r in scans.found.where("token IS NOT NULL").collect()}
    assert tokens == {("1", "visiarnero"), ("2", "zulche band")}
    assert {r.token: r.word for r in scans.corrected.collect()}["visiarnero"] == "visiamero"
    texts = {r.rec_id: r.text for r in repair(scanned, scans).collect()}
    assert texts["1"] == "We rank the visiamero edges." and texts["3"] == "We rank visiamero and lumkanvik-gauges over quarry."
