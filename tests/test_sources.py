import json

from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import metadata
from foliograph.operators.paper_rank import phase_one, rank_papers
from foliograph.sources.content_lists import caption, plain_table, read_content_lists, read_records, resolved_path, write_graph


def test_content_lists(spark, tmp_path):
    items = [{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "text", "content": "Body", "page": 2}]
    for name, payload in (("p1", items), ("p2", {"data": items}), (".hidden", items)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "paper_content_list.json").write_text(json.dumps(payload))
    got = {(r.paper_id, r.item_index, r.text, r.page_idx) for r in read_content_lists(spark, str(tmp_path)).collect()}
    assert got == {(p, i, t, n) for p in ("p1", "p2") for i, (t, n) in enumerate((("Title", 0), ("Body", 2)))}


def test_records_and_graph(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert {r.a for r in read_records(spark, str(tmp_path / "r.jsonl"), "a int", strict=False).collect()} == {1, 3}
    nodes = spark.createDataFrame([("n1", "paper"), ("n2", "venue")], "node_id string, node_type string")
    edges = spark.createDataFrame([("n1", "n2", "t")], "source_id string, target_id string, edge_type string")
    write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).where("node_type = 'venue'").count() == 1


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.normalize_text(F.lit(" a \t b\r\n\n\n\nc ")).alias("a"),
        tx.token_estimate(F.lit("two words 中文 +")).alias("b"),
        tx.reference_label(F.lit("Fig. 3. A chart")).alias("c"),
        tx.entity_key(F.lit("Zoë Müller-Łuk")).alias("d"),
        tx.preview(F.lit("abcdef"), 3).alias("e"),
        tx.is_low_signal(F.lit(None).cast("string")).alias("f"),
        plain_table(F.lit("<td>a</td><td>b</td>")).alias("g"),
        resolved_path(F.lit("./x.png"), "/root/").alias("h"),
        tx.overlap_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("i"),
    ).first()
    assert row.a == "a b\n\nc" and row.b == 5 and row.c == "figure 3" and row.e == "abc..." and row.f and row.g == "a b"
    assert row.d == "zoe_muller_uk" or row.d == "zoe_muller_luk"
    assert row.h == "/root/x.png" and abs(row.i - 2 / 3) < 1e-9
    df = spark.createDataFrame([([], ["x"])], "a array<string>, b array<string>")
    assert df.select(caption(["a", "b"]).alias("c")).first().c == ["x"]


def test_roles_and_front_matter(spark):
    role = metadata.section_role
    row = spark.range(1).select(*[role(F.lit(t)) for t in ("3 Methods", "References", "Experiments", "Funding", "Other")]).first()
    assert list(row) == ["methods", "citation", "results", "admin", "other"]
    blocks = [("p", 0, "Masked graphs for logs", 1), ("p", 1, "Published 2019, doi 10.1234/AB.c", None), ("p", 2, "Keywords: a; b, a", None), ("q", 0, None, None)]
    got = metadata.front_matter(spark.createDataFrame(blocks, "paper_id string, item_index int, text string, text_level int")).collect()
    assert [(r.title, r.year, r.doi, r.keywords) for r in got] == [("Masked graphs for logs", "2019", "10.1234/ab.c", ["a", "b"])]


def test_rank_assembly(spark):
    direct = spark.createDataFrame([("q", "p1", 0.5), ("q", "p3", 0.1)], "query string, paper string, score double")
    matches = spark.createDataFrame([("q", "e1", "task"), ("q", "e2", "model")], "query string, entity string, kind string")
    edges = spark.createDataFrame([("p1", "e1", 1.0), ("p1", "e2", 0.5), ("p2", "e1", 1.0)], "paper string, entity string, confidence double")
    parts = phase_one(direct, matches, edges)
    total = {r.paper: r.s for r in parts.groupBy("paper").agg(F.round(F.sum("delta"), 4).alias("s")).collect()}
    bonus = lambda e: 0.65 * e + 0.85 * e + 1.1 * (e - 1) + 1.4 * e + 2.2 * (e - 1)
    assert total["p1"] == round(0.24 * 0.5 + 2.8 * 1.5 + 3 + 20 + 12.8 + 58 + bonus(2), 4)
    assert total["p2"] == round(2.8 + 1.5 + 5 - 4 + bonus(1), 4)
    cross = spark.createDataFrame([("p1", "p4", 9.0, 1.0, 2)], "source_id string, target_id string, weight double, confidence double, shared_count int")
    got = {r.paper: r.score for r in rank_papers(parts, cross, 9).collect()}
    assert got["p4"] == 4.0 and set(got) == {"p1", "p2", "p3", "p4"}
