import math

from pyspark.sql import functions as F

from foliograph.operators import bibliography as bib
from foliograph.operators import graph as g
from foliograph.operators import ranking as rk
from foliograph.operators.components import connected_components
from foliograph.operators.mentions import mentions
from foliograph.operators.ranks import counted_values
from foliograph.operators.structure import fold_blocks, open_sections, split_long
from foliograph.operators.tfidf import char_ngrams, rank_documents
from foliograph.operators.windows import choose


def test_weights_equalise_relations(spark):
    e = spark.createDataFrame([("a", "d", "r", 0.2), ("b", "d", "r", 0.8), ("c", "d", "s", 0.5)], "source_id string, target_id string, relation string, confidence double")
    got = {r.source_id: round(r.weight, 6) for r in g.normalized_weights(e).collect()}
    assert got == {"a": 0.1, "b": 0.4, "c": 0.5}


def test_harmonic(spark):
    row = spark.range(1).select(g.harmonic(F.lit(0.0), F.lit(0.7)).alias("a"), F.round(g.harmonic(F.lit(0.4), F.lit(0.8)), 4).alias("b")).first()
    assert (row.a, row.b) == (0.0, 0.5333)


def test_fusion_and_ties(spark):
    rows = lambda ids: spark.createDataFrame([("q", x, i) for i, x in enumerate(ids, 1)], "q string, k string, place int")
    got = {r.k: r.score for r in rk.fuse(rows("ab"), rows("cba"), group="q", key="k", weight=0.3, k=9).collect()}
    assert got == {"a": round(0.7 + 0.3 * 61 / 63, 4), "b": round(0.7 * 61 / 62 + 0.3 * 61 / 62, 4), "c": 0.3}


def test_tied_channels_share_a_rank(spark):
    s = spark.createDataFrame([("q", "dataset", "p1", 0.8), ("q", "dataset", "p2", 0.8), ("q", "dataset", "p3", 0.1)], "query string, kind string, paper string, score double")
    got = {r.paper: r.total for r in rk.competition_recall(s, weights={"dataset": 3.0}, limit=1).collect()}
    assert got == {"p1": round(3 / 61, 8), "p2": round(3 / 61, 8)}


def test_windows():
    boxes = [(0, 0, 1, 1, 0.9), (0, 0, 0.3, 0.3, 0.5)]
    assert choose(boxes, 3) == [1]
    four = [(0.5 * (i % 2), 0.5 * (i // 2), 0.5 * (i % 2) + 0.5, 0.5 * (i // 2) + 0.4, 1 - i / 10) for i in range(4)]
    assert choose(four, 4) == [0, 1]
    assert choose([(0, 0, 1, 1, 0.9)], 1) == [0]


def test_components(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("z", "z"), ("y", "w"), (None, "q")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert {got[f"n{i:02d}"] for i in range(31)} == {"n00"}
    assert (got["x"], got["y"], got["w"], got["z"]) == ("w", "w", "w", "z")
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_ranks_with_a_hot_value(spark):
    rows = [("g", 1.0)] * 50 + [("g", float(i)) for i in range(2, 40)] + [("h", 5.0)]
    got = {(r.k, r.v): (r.below, r.equal, r.total) for r in counted_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got[("g", 1.0)] == (0, 50, 88) and got[("g", 39.0)] == (87, 1, 88) and got[("h", 5.0)] == (0, 1, 1)


def test_tfidf_against_plain_python(spark):
    docs = {"a": "tidal station logs", "b": "river gauge charts and logs", "c": "quarry accounts", "d": ""}
    asks = {"q": "station charts", "r": "zzz"}
    want = {}
    for q, t in asks.items():
        grams = {k: char_ngrams(v) for k, v in docs.items()}
        grams[""] = char_ngrams(t)
        n = len(docs) + 1
        idf = {x: math.log((1 + n) / (1 + sum(x in c for c in grams.values()))) + 1 for c in grams.values() for x in c}
        vec = {k: {x: c * idf[x] for x, c in v.items()} for k, v in grams.items()}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        for k in docs:
            dot = sum(w * vec[""].get(x, 0) for x, w in vec[k].items())
            if dot:
                want[q, k] = round(dot / norm(vec[k]) / norm(vec[""]), 5)
    d = spark.createDataFrame(list(docs.items()), "id string, t string")
    a = spark.createDataFrame(list(asks.items()), "qid string, t string")
    got = rank_documents(d, a, key="id", text="t", query_key="qid", query_text="t", k=10)
    assert {(r.query, r.key): round(r.score, 5) for r in got.collect()} == want


def test_structure():
    assert open_sections(["A"], "B", 4) == ["A", "B"]
    assert open_sections(["A", "B"], "C", 2) == ["C"]
    assert open_sections(["A"], "T", 1) == ["A"]
    long = " ".join(f"Sentence number {i} ends here." for i in range(60))
    assert all(len(p) <= 300 for p in split_long(long, 300)) and " ".join(split_long(long, 300)) == long
    blocks = [(0, "Paper", 1, 0), (1, "Lead text.", None, 0), (2, "Methods", 2, 0), (3, long, None, 0), (4, None, None, 1), (5, "Tail.", None, 0)]
    got = list(fold_blocks(iter(blocks), 350, 700, 1100))
    assert got[0][0] == ["Front Matter"] and got[0][1] == 0 and got[0][4] == "Lead text."
    assert all(c[0] == ["Methods"] and len(c[4]) <= 1100 for c in got[1:]) and got[-1][4].endswith("Tail.")


def test_bibliography(spark):
    text = "[1] Ann Doe (2019). Reading tidal logs with graphs. Journal of Logs.\n[2] B. Roe, C. Poe. 2020. Masked page graphs for river charts. doi 10.1234/abcd.5678 and more prose."
    d = bib.entries(spark.createDataFrame([(1, text), (2, None), (3, "Disclaimer: the 2020, text")], "id int, t string"), "id", "t")
    rows = {(r.id, r.label): r for r in bib.parse(d.where(bib.is_citation(F.col("entry"))), "entry", across=False).collect()}
    assert set(rows) == {(1, "1"), (1, "2")}
    one, two = rows[1, "1"], rows[1, "2"]
    assert (one.year, one.lead_author, one.title) == ("2019", "ann", "Reading tidal logs with graphs")
    assert two.doi == "10.1234/abcd.5678" and two.match_key == "doi:10.1234/abcd.5678"


def test_merge_references(spark):
    title = "Masked page graphs for reading river gauge charts"
    rows = [("r1", title, "2019", "doe"), ("r2", title.upper(), "2020", "doe"), ("r3", title, "2019", "doe"), ("r4", "Another work on peat core tables", "2019", "roe"), ("r5", title, "1990", "zoe")]
    got = {r.node_id: r.cluster for r in bib.merge_references(spark.createDataFrame(rows, "node_id string, title string, year string, author string")).collect()}
    assert got["r1"] == got["r2"] == got["r3"] == "r1" and got["r4"] == "r4" and got["r5"] == "r5"


def test_mentions(spark):
    t = spark.createDataFrame([("a", "Deep graph nets and graph. Graphs, graph nets"), ("b", None)], "id string, t string")
    n = spark.createDataFrame([("e1", "graph"), ("e2", "graph nets")], "entity string, name string")
    got = {(r.entity, r.mentions) for r in mentions(t, n, key="id", text="t").collect()}
    assert got == {("e1", 1), ("e2", 2)}


def test_constraints_and_dangling(spark):
    links = spark.createDataFrame([("p1", "x"), ("p1", "y"), ("p2", "x")], "source_id string, target_id string")
    groups = spark.createDataFrame([("q", "g1", "x"), ("q", "g2", "y"), ("q", "g2", "z")], "query string, grp string, target_id string")
    assert [(r.query, r.source_id) for r in g.all_constraints(links, groups).collect()] == [("q", "p1")]
    assert g.dangling(links, spark.createDataFrame([("x",)], "node_id string"), "target_id").count() == 1
