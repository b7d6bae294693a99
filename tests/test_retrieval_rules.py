"""What queries ask for, boosts, modes, fusion, local ranking, mentions, contexts, layers and windows."""

import math

import pytest

from pyspark.sql import functions as F

from foliograph.operators import bundle, evidence, lookups, paper_rank, semantic, windows
from foliograph.operators import graph as g
from foliograph.operators import query_rules as qr
from foliograph.operators.ranking import cosine_ranking, fuse
from foliograph.operators.tfidf import char_ngrams, gram_hashes, score_documents


def _asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query string, wording string")


def test_intents(spark):
    d = _asked(spark, "explain the graph of entities", "show the result graph", "a figure of pages", "which papers use maps and ink", "Compare FolioNet with mapper").select(qr.is_visual(F.col("wording")).alias("v"), qr.is_list(F.col("wording")).alias("l"), qr.has_conjunction(F.col("wording")).alias("c"), qr.handles(F.col("wording")).alias("h"))
    rows = d.collect()
    assert [r.v for r in rows] == [False, True, True, False, False] and [r.l for r in rows] == [False, False, False, True, False] and rows[3].c and rows[4].h == ["FolioNet"]
    phrases = _asked(spark, 'the title is "Reading Quarry Maps"', "Quarry Ledger Graphs: this paper", "plain").select(qr.title_phrases(F.col("wording")).alias("p")).collect()
    assert "Reading Quarry Maps" in phrases[0].p and phrases[1].p == ["Quarry Ledger Graphs"] and phrases[2].p == []


def test_named_sources(spark):
    papers = spark.createDataFrame([("p1", "FolioNet: Reading Maps"), ("p2", "Inker: Reading Ink"), ("p3", "Twice: One"), ("p4", "Twice: Two"), ("p5", None)], "paper string, title string")
    asked = _asked(spark, "Compare FolioNet with inker", "explain FolioNets", "which papers compare FolioNet", "explain Twice", "")
    assert {tuple(r) for r in qr.named_sources(asked, papers).collect()} == {("q0", "p1"), ("q0", "p2")}


def test_boosts(spark):
    papers = spark.createDataFrame([("p1", "FolioNet: Reading Maps"), ("p2", "Reading Maps of Old Harbours"), ("p3", None)], "paper string, title string")
    asked = _asked(spark, "x").withColumn("phrases", F.array(F.lit("folionet"), F.lit("maps of old harbours")))
    hits = qr.title_bonus(asked, papers)
    assert {(r.paper, r.delta) for r in hits.collect()} == {("p1", 174.0), ("p2", 58.0)} and qr.title_isolation(asked, hits).first().delta == -34
    handles = _asked(spark, "x").withColumn("handles", F.array(F.lit("FolioNet")))
    figures = spark.createDataFrame([("p2", "plot of folionet")], "paper string, text string")
    assert {(r.paper, r.delta) for r in qr.handle_bonus(handles, papers, figures).collect()} == {("p1", 340.0), ("p2", 48.0)}
    m = spark.createDataFrame([("q", "a", "e1"), ("q", "b", "e2")], "query string, concept string, entity string")
    links = spark.createDataFrame([("p1", "e1"), ("p1", "e2"), ("p2", "e1")], "paper string, entity string")
    got = {r.paper: r.delta for r in qr.concept_bonus(m, links).collect()}
    assert got == {"p1": round(2.4 + 1.6 + 4.8 + 2.8, 6), "p2": 1.2}
    scores = spark.createDataFrame([("q", "p1", 3.0), ("q", "p2", 5.0)], "query string, paper string, score double")
    plain = spark.createDataFrame([("q", True)], "query string, joint boolean")
    none = spark.createDataFrame([], "query string, paper string")
    end = {r.paper: r.score for r in paper_rank.finish(scores, none, qr.concept_bonus(m, links), plain).collect()}
    assert end["p1"] == round(3 + got["p1"] + 0.5, 6) and end["p2"] == round(0.002 - 1, 6)
    kept = spark.createDataFrame([("q", "p2")], "query string, paper string")
    end = {r.paper: r.score for r in paper_rank.finish(scores, kept, qr.concept_bonus(m.limit(0), links), plain.limit(0)).collect()}
    assert end == {"p1": -21.0, "p2": 5.35}


def test_handles_meet_by_pieces(spark):
    papers = spark.createDataFrame([("p1", "FolioNet: Reading Maps"), ("p2", "A Folio-Net of Maps"), ("p3", "GPTX"), ("p4", "x"), ("p5", None)], "paper string, title string")
    figures = spark.createDataFrame([("p4", "a plot of gptx"), ("p4", "gptx again"), ("p3", "")], "paper string, text string")
    handles = _asked(spark, "x", "y").withColumn("handles", F.when(F.col("query") == "q0", F.array(F.lit("Folio-Net"), F.lit("NoSuch"))).otherwise(F.array(F.lit("GPTX"))))
    got = qr.handle_bonus(handles, papers, figures)
    assert {tuple(r) for r in got.collect()} == {("q0", "p1", 340.0), ("q0", "p2", 96.0), ("q1", "p3", 340.0), ("q1", "p4", 48.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fusion_with_allowed(spark):
    left = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, k string, place int")
    right = spark.createDataFrame([("q", "c", 1), ("q", "b", 2), ("q", "a", 3)], "query string, k string, place int")
    allowed = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, k string")
    got = {r.k: r.score for r in fuse(left, right, group="query", key="k", weight=0.3, k=5, allowed=allowed).collect()}
    assert set(got) == {"a", "b"} and got["a"] == round(0.7 + 0.3 * 61 / 63, 4)
    free = fuse(left, right, group="query", key="k", weight=0.3, k=5).collect()
    assert free[-1].k == "c" or min(free, key=lambda r: r.score).k == "c"
    assert {r.k for r in fuse(left, right, group="query", key="k", weight=0.0, k=5).collect()} == {"a", "b"}


def test_hashed_grams():
    for text in ("Reading  maps", "a", "ab", "", None, "ünïcode 語 text", "aaaa aaaa"):
        grams, n = gram_hashes(text)
        assert sorted(n) == sorted(char_ngrams(text).values()) and len(grams) == len(char_ngrams(text))


def test_scores_against_python(spark):
    docs = [("d1", "reading quarry maps"), ("d2", "harbour ledgers"), ("d3", None), ("d4", ""), ("d1", "reading quarry maps"), (None, "x")]
    asked = [("q1", "quarry maps"), ("q2", None), ("q3", "zzz")]
    got = {(r.query, r.key): r.score for r in score_documents(spark.createDataFrame(docs, "k string, t string"), spark.createDataFrame(asked, "q string, t string"), key="k", text="t", query_key="q", query_text="t").collect()}
    texts = {"d1": "reading quarry maps", "d2": "harbour ledgers", "d3": "", "d4": ""}
    counts = {k: char_ngrams(t) for k, t in texts.items()}
    q, n = char_ngrams("quarry maps"), len(texts) + 1
    idf = lambda x: math.log((1 + n) / (1 + sum(x in c for c in counts.values()) + (x in q))) + 1
    norm = lambda c: math.sqrt(sum((v * idf(x)) ** 2 for x, v in c.items()))
    want = {("q1", k): round(sum(v * q[x] * idf(x) ** 2 for x, v in c.items()) / (norm(c) * norm(q)), 6) for k, c in counts.items() if set(c) & set(q)}
    assert got == want


def test_vectors_in_blocks(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(7, None)]
    v = spark.createDataFrame(rows, "vec_id long, e array<float>")
    got = cosine_ranking(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query"), "e"), key="vec_id", vector="e", k=2).orderBy("place").collect()
    assert [r.vec_id for r in got] == [1, 2] and cosine_ranking(v, v.limit(0).select(F.col("vec_id").alias("query"), "e"), key="vec_id", vector="e", k=2).count() == 0


def test_figures(spark):
    d = spark.createDataFrame([("Figure 3 and fig. 13, Table 2b",)], "t string")
    assert d.select(evidence.figure_labels(F.col("t")).alias("l")).first().l == ["figure 3", "figure 13", "table 2b"]
    f = spark.createDataFrame([("f1", "b", "Figure 3 quarry maps", "figure 3"), ("f2", "b", "Table 1", "")], "figure string, body string, caption string, label string")
    got = {r.figure: round(r.bonus, 6) for r in evidence.figure_bonus(f, _asked(spark, "figure 3 of quarry maps")).collect()}
    assert got == {"f1": round(0.12 * 2 + 0.3 + 0.12, 6)}
    pairs = spark.createDataFrame([("q", "s", "quarry maps")], "query string, part string, wording string")
    records = spark.createDataFrame([("s", "r1", "quarry maps here"), ("s", "r2", "harbour"), ("s", "r3", None), ("t", "r4", "quarry maps")], "part string, record string, text string")
    assert [r.record for r in evidence.local_ranking(pairs, records, 1).collect()] == ["r1"]


def test_mentions(spark):
    aliases = spark.createDataFrame([("method", "ledger walk", "ledger walk"), ("metric", "f1 score", "f1"), ("model", "cnn", "CNN"), ("method", "", "")], "kind string, name string, alias string")
    texts = spark.createDataFrame([("s1", "We train a CNN and the Ledger Walk on the Harbour Page dataset. Table detection is next. F1 grows.", "methods"), ("s2", None, "methods"), ("s3", "", None)], "key string, text string, section_group string")
    got = {(r.kind, r.name, r.source) for r in semantic.extract(texts, aliases).collect()}
    assert {("method", "ledger walk", "rule_extract"), ("metric", "f1 score", "rule_extract"), ("model", "cnn", "rule_extract"), ("method", "cnn", "model_bridge"), ("dataset", "Harbour Page dataset", "rule_extract"), ("task", "table detection", "rule_extract")} <= got
    assert semantic.method_surface("the proposed graph clustering") == "graph clustering" and semantic.is_method("graph clustering") and not semantic.is_method("selection")
    assert semantic.task_surface("the risk prediction") == "risk prediction" and semantic.task_surface("of detection") == "" and semantic.without_head("graph clustering method") == "graph clustering"
    d = spark.createDataFrame([("Walker beats. It outperforms walker.", "walker"), ("We compare with walker as a baseline.", "walker"), ("x", "walker")], "t string, s string")
    assert [r[0] for r in d.select(semantic.comparison_only(F.col("t"), F.col("s"))).collect()] == [False, True, False]
    edges = semantic.mention_edges(semantic.extract(texts, aliases), 0)
    assert {r.edge_type for r in edges.collect()} == {"section_uses_method", "section_uses_model", "section_uses_dataset", "section_addresses_task", "section_reports_metric"}
    up = semantic.promoted(edges, spark.createDataFrame([("s1", "paper:p")], "node string, paper string"))
    assert up.where("edge_type = 'paper_uses_model'").first().source_id == "paper:p"


def test_context(spark):
    rows = [("q", 1, 0, "paper", 1, "## a", False), ("q", 1, 0, "entity", 1, "one two three", False), ("q", 1, 1, "section", 1, "### s", False), ("q", 1, 1, "summary", 1, "four five six", False), ("q", 1, 1, "chunk", 1, "seven eight", False), ("q", 2, 0, "paper", 1, "## b", False)]
    lines = spark.createDataFrame(rows, "query string, paper_no int, section_no int, kind string, item_no int, line string, sure boolean")
    kinds = lambda n: {(r.paper_no, r.kind) for r in bundle.shrink(lines, n).collect()}
    assert len(kinds(100)) == 6 and (1, "entity") not in kinds(16) and (1, "summary") in kinds(16)
    assert (1, "summary") not in kinds(11) and (1, "chunk") in kinds(11) and kinds(1) == {(1, "paper"), (1, "section")}
    out = bundle.render(bundle.shrink(lines, 100), _asked(spark, "w").withColumn("query", F.lit("q"))).first()
    assert out.markdown.startswith("# Query\nw\n\n# Context Bundle\n## a\none two three") and out.n_lines == 6


def test_layers(spark):
    w = spark.createDataFrame([("a", "b", "r", 0.5), ("c", "b", "r", 0.5)], "source_id string, target_id string, relation string, weight double")
    f = spark.createDataFrame([(n, d, v) for n, vs in (("a", (1.0, 0.0)), ("c", (0.0, 1.0)), ("b", (1.0, 0.0))) for d, v in enumerate(vs)], "node string, dim int, value double")
    gates = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 2.0)], "relation string, dim int, gate double")
    m = spark.createDataFrame([("r", 0, 1, 1.0), ("r", 1, 0, 1.0)], "relation string, i int, j int, w double")
    got = {(r.node, r.dim): r.value for r in g.gated_messages(w, f, gates, m).collect()}
    assert got == {("b", 0): 0.5, ("b", 1): 1.0}
    out = {(r.node, r.dim): r.value for r in g.residual(f, g.gated_messages(w, f, gates, m)).collect()}
    x, y = 1 + 0.25 * 0.5 / math.sqrt(1.25), 0.25 / math.sqrt(1.25)
    assert abs(out["b", 0] - x / math.hypot(x, y)) < 1e-9 and out["a", 0] == 1.0


def test_windows(spark):
    images = spark.createDataFrame([("i", 300, 180, 8, 8, 285, 170)], "image string, width int, height int, cx0 int, cy0 int, cx1 int, cy1 int")
    rows = windows.candidate_windows(images).collect()
    boxes = {(r.x0, r.y0, r.x1, r.y1) for r in rows}
    assert len(rows) == len(boxes) == 360 and {(0, 0, 300, 180), (8, 8, 285, 170)} <= boxes
    b = spark.createDataFrame([("i", 1, 0.0, 0.0, 1.0, 1.0, 0.9), ("i", 2, 0.0, 0.0, 0.3, 0.3, 0.5), ("j", 1, 0.0, 0.0, 1.0, 1.0, 0.2)], "image string, no int, x0 double, y0 double, x1 double, y1 double, score double")
    assert {(r.image, r.no) for r in windows.choose_windows(b).collect()} == {("i", 2), ("j", 1)}


def test_windows_are_not_shuffled(spark):
    images = spark.createDataFrame([("i", 300, 180, 8, 8, 285, 170), ("j", 40, 40, 0, 0, 40, 40), ("k", 48, 500, 8, 8, 40, 492)], "image string, width int, height int, cx0 int, cy0 int, cx1 int, cy1 int")
    df = windows.candidate_windows(images)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert {(r.x0, r.y0, r.x1, r.y1, r.no) for r in rows if r.image == "j" and r.no == 0} == {(0, 0, 40, 40, 0)} and sum(r.no < 2 for r in rows if r.image == "j") == 1
    assert all(len({(r.x0, r.y0, r.x1, r.y1) for r in rows if r.image == i}) == sum(r.image == i for r in rows) <= 360 for i in "ijk")


def test_lookups(spark):
    papers = spark.createDataFrame([("p1", "n1", "Reading Quarry Maps"), ("p2", "n2", "Harbour Lights"), ("p3", "n3", "Harbour Lights"), ("p4", "n4", None)], "paper string, node_id string, title string")
    find = lookups.find_paper
    assert find(papers, "n1") == "p1" and find(papers, title="reading  QUARRY maps") == "p1" and find(papers, title="quarry") == "p1"
    for bad in ({"paper_id": "x"}, {"title": "harbour lights"}, {"title": "nothing"}, {"title": " "}):
        with pytest.raises(ValueError):
            find(papers, **bad)
    refs = spark.createDataFrame([("p1", "Reading Quarry Ledgers with Sparse Graphs"), ("p2", "Reading Quarry Ledgers with Sparse Graphs Revisited"), ("p3", "Sparse graphs with quarry ledgers"), ("p4", None)], "paper string, title string")
    wanted = spark.createDataFrame([("w", "Reading quarry ledgers with sparse graphs"), ("v", "short")], "wanted string, title string")
    assert {r.paper: r.score for r in lookups.like_references(wanted, refs).collect()} == {"p1": 2.05, "p2": 1.8, "p3": 1.7}
    d = spark.createDataFrame([("misaligned pages", [["align"], ["page", "pages"]]), ("we align pages", [["align"], ["page", "pages"]]), (None, [["x"]]), ("x", [])], "t string, g array<array<string>>")
    assert [r[0] for r in d.select(lookups.all_groups(F.col("t"), F.col("g"))).collect()] == [False, True, False, True]
    a = spark.createDataFrame([("Ann Whit, Bob Green, Cy Lum", ["Ann Whit, Bob Green, Cy Lum"]), ("Ann Whit1 and Bob Green2", []), ("x", ["Ann Whit", "Bob Green"]), (None, None)], "t string, k array<string>")
    assert [r[0] for r in a.select(lookups.repaired_authors(F.col("t"), F.col("k"))).collect()] == [["Ann Whit", "Bob Green", "Cy Lum"], ["Ann Whit", "Bob Green"], ["Ann Whit", "Bob Green"], []]
    w = spark.createDataFrame([("n", "t", 0, 0, 2.0), ("n", "t", 0, 1, 0.0), ("n", "a", 0, 0, 0.0), ("n", "a", 0, 1, 3.0), ("z", "t", 0, 0, 0.0)], "node string, field string, window int, dim int, value double")
    assert {(r.node, r.dim): round(r.value, 6) for r in lookups.mean_of_fields(w).collect()} == {("n", 0): round(2**-0.5, 6), ("n", 1): round(2**-0.5, 6)}
