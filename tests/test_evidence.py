from foliograph.operators.evidence import _figure_scores, diversify, figure_bonus, owners, rank_figures, shrink
from foliograph.plans import retrieval_queries
from foliograph.plans.retrieval_queries import section_ranking


def test_shrink_gives_in_order():
    sizes = {"chunks": [5, 5], "entities": [3], "summaries": [4]}
    order = [("entities", 0), ("summaries", 0), ("chunks", 1)]
    assert shrink(sizes, order, 14) == {"chunks": 2, "entities": 0, "summaries": 1}
    assert shrink(sizes, order, 6) == {"chunks": 1, "entities": 0, "summaries": 0}
    assert shrink(sizes, order, 1) == {"chunks": 1, "entities": 0, "summaries": 0}
    assert shrink(sizes, order, 99) == {"chunks": 2, "entities": 1, "summaries": 1}


def test_diversify(spark):
    rows = [("q", "a", 9.0, "m"), ("q", "b", 8.0, "m"), ("q", "c", 1.0, "r"), ("q", "d", 7.0, "m")]
    df = spark.createDataFrame(rows, "query string, section string, score double, role string")
    got = [(r.section, r.place) for r in diversify(df, ["query"], "role", 3).orderBy("place").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_owners(spark):
    e = spark.createDataFrame([("P1", "s1"), ("s1", "f1"), ("P2", "s2"), ("P2", "s1")], "source_id string, target_id string")
    p = spark.createDataFrame([("P1", "p1"), ("P2", "p2")], "node_id string, paper string")
    got = {r.node: (r.paper, r.n_papers) for r in owners(e, p).collect()}
    assert got == {"P1": ("p1", 1), "P2": ("p2", 1), "s1": ("p1", 2), "s2": ("p2", 1), "f1": ("p1", 2)}


def test_figures(spark):
    f = spark.createDataFrame([("a", "chart", "drift of logs", "drift of logs", "figure 1"), ("b", "table", "drift of logs", "drift of logs", "table 1"), ("c", "image", None, None, None)], "figure string, kind string, body string, caption string, label string")
    q = spark.createDataFrame([("q", "chart of drift", ["chart", "image"])], "query string, wording string, kinds array<string>")
    got = [r.figure for r in rank_figures(f, q, 5).orderBy("place").collect()]
    assert got == ["a", "b"]


def test_sections_of_every_paper(spark, tmp_path):
    # 130 papers of two sections each, in one of which nothing of the query stands
    rows = [(f"s{i:03d}{part}", "section", f"p{i:03d}", title, text) for i in range(130) for part, title, text in (("a", "Results", "page drift of graphs"), ("b", "Method", "xyz"))]
    spark.createDataFrame(rows, "node_id string, node_type string, paper_id string, section_title string, section_text string").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([("q1", "drift of graphs"), ("q2", "page")], "query_id string, query string").write.parquet(f"{tmp_path}/query_cases.parquet")
    spark.createDataFrame([("section_mentions_method", "s000b", "e", 1.0)], "edge_type string, source_id string, target_id string, confidence double").write.parquet(f"{tmp_path}/edges.parquet")
    got = section_ranking(spark, str(tmp_path)).collect()
    assert {(r.query, r.section) for r in got} == {(q, r[0]) for q in ("q1", "q2") for r in rows}
    assert next(r.score for r in got if r.section == "s000b" and r.query == "q1") > next(r.score for r in got if r.section == "s001b" and r.query == "q1")


def test_figures_have_full_scores(spark):
    # twelve equal labels; a cut of a channel gave the last of them no label score
    rows = [(f"f{i:02d}", "image", "drift of logs" if i == 11 else "some other page", "x", "figure 2") for i in range(12)]
    f = spark.createDataFrame(rows, "figure string, kind string, body string, caption string, label string")
    q = spark.createDataFrame([("q", "drift in figure 2", [])], "query string, wording string, kinds array<string>")
    few, all_of_them = ([(r.figure, r.score) for r in rank_figures(f, q, k).orderBy("place").collect()] for k in (1, 12))
    assert few == all_of_them[:1] and few[0][0] == "f11"


def test_figures_are_cut_where_they_are_read(spark):
    # 600 figures that share n-grams with both queries, of which few may be among the two best
    rows = [(f"f{i:03d}", "image", f"drift of logs {i}", "Figure 2 of drift" if i == 599 else f"logs {i}", "figure 2") for i in range(600)]
    f = spark.createDataFrame(rows, "figure string, kind string, body string, caption string, label string").coalesce(1)
    q = spark.createDataFrame([("q", "drift in figure 2", []), ("r", "logs of drift", ["chart"])], "query string, wording string, kinds array<string>")
    assert _figure_scores(f, q, None).count() == 1200 and _figure_scores(f, q, 2).count() < 600
    got = {(r.query, r.figure): round(r.bonus, 6) for r in _figure_scores(f, q, None).where("bonus > 0").collect()}
    assert got == {(r.query, r.figure): round(r.bonus, 6) for r in figure_bonus(f, q).collect()}


def test_papers_have_direct_scores(spark, tmp_path, monkeypatch):
    # the direct scores of 210 papers go into the sum
    papers = [(f"n{i:03d}", f"Drift of logs {i}", None) for i in range(210)]
    spark.createDataFrame(papers, "node_id string, title string, abstract string").write.parquet(f"{tmp_path}/papers.parquet")
    spark.createDataFrame([("q", "drift of logs")], "query_id string, query string").write.parquet(f"{tmp_path}/query_cases.parquet")
    edges = "edge_id string, edge_type string, source_id string, target_id string, confidence double, source string, mention_count long"
    spark.createDataFrame([], edges).write.parquet(f"{tmp_path}/edges.parquet")
    nodes = "node_id string, node_type string, paper_id string, canonical_name string, caption array<string>, section_title string"
    spark.createDataFrame([], nodes).write.parquet(f"{tmp_path}/nodes.parquet")
    seen = []
    monkeypatch.setattr(retrieval_queries, "cross_edges", lambda *_: spark.createDataFrame([], "x string"))
    monkeypatch.setattr(retrieval_queries, "rank_papers", lambda parts, cross, k, third: seen.append(parts) or parts)
    retrieval_queries.ranked_papers(spark, str(tmp_path))
    assert seen[0].where("component = 'direct'").count() == 210
