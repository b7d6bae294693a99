"""Front matter, institutions, forms of names, nested texts and paths."""

from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import front_matter as fm
from foliograph.operators.metadata import role_of
from foliograph.operators.query_rules import background_sections
from foliograph.sources import content_lists as cl


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_forms(spark):
    assert _one(spark, " Ångström,  José-María ", tx.person_form) == "angstrom jose-maria"
    assert _one(spark, "José-María", tx.author_key) == "jose_maria" and _one(spark, "Ế ß", tx.compact_alias) == "e"
    assert _one(spark, "A-1 b", tx.query_compact) == "a1b" and _one(spark, None, tx.query_compact) == ""
    assert _one(spark, "abcdef ghi", lambda c: tx.trim_to(c, 5)) == "abcd…" and _one(spark, "abc", lambda c: tx.trim_to(c, 5)) == "abc"
    assert _one(spark, "J. Whitfield", tx.first_author) == "whitfield" and _one(spark, "Whitfield J", tx.first_author) == "whitfield" and _one(spark, "", tx.first_author) == ""
    d = spark.createDataFrame([("a", " a ", None, ""), ("b", "c", "b", "d")], "p string, q string, r string, s string")
    assert [r[0] for r in d.select(tx.join_unique("p", "q", "r", "s")).collect()] == ["a", "b\nc\nd"]
    pages = spark.createDataFrame([(0, 0), (5, 6), (None, None), (2, None)], "a int, b int").select(tx.page_label("a", "b").alias("l"))
    assert [r.l for r in pages.collect()] == ["p.1", "p.6-7", "", "p.3"]
    boxes = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,), ([1.0, None, 3.0, 4.0],)], "b array<double>").select(tx.box("b").alias("b"))
    assert [r.b is not None for r in boxes.collect()] == [True, False, False, False]


def test_front_matter(spark):
    rows = [
        ("p", 0, "title", "Reading Ledgers", 1), ("p", 1, "text", "Received: 3 May", None), ("p", 2, "text", "Ann Whit; Bob Green", None), ("p", 3, "text", "1 Dept. of Maps, University of Harlow, Spain", None),
        ("p", 4, "text", "Harlow Institute of Reading", None), ("p", 5, "text", "Journal of Quarry Sciences", None), ("p", 6, "text", "Introduction", 2), ("p", 7, "text", "University of Nowhere", None),
        ("q", 0, "text", None, None), ("q", 1, "text", " ", None),
    ]
    blocks = spark.createDataFrame(rows + rows[:3], "paper_id string, item_index int, type string, text string, text_level int")
    lines = fm.front_lines(blocks)
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["Ann Whit; Bob Green", "1 Dept. of Maps, University of Harlow, Spain", "Harlow Institute of Reading", "Journal of Quarry Sciences"]
    got = fm.authors_and_institutions(lines)
    row = got.first()
    assert row.authors_text == "Ann Whit; Bob Green" and row.authors == ["Ann Whit", "Bob Green"] and len(row.institutions) == 2
    assert fm.venue_lines(blocks, got).first().venue == "Journal of Quarry Sciences"
    assert fm.front_lines(blocks.limit(0)).count() == 0


def test_institutions(spark):
    rows = ["1 Dept. of Maps, University of Harlow, Spain", "Spain", "12 High Street, 90210 Town", "University of Harlow; Institute of Ink, Spain", "this study aims to evaluate patients", None, ""]
    got = {r.surface: (r.name, r.country) for r in fm.institution_names(spark.createDataFrame([(r,) for r in rows], "surface string")).collect()}
    assert got[rows[0]] == ("University of Harlow", "Spain") and got[rows[1]][0] == "" and got[rows[2]][0] == "" and got[rows[3]][0] == "University of Harlow" and got[rows[4]][0] == ""
    named = spark.createDataFrame([("p1", "Univ. Harlow", "University of Harlow", "1", None), ("p2", "University of Harlow", "University of Harlow", "2", "Spain"), ("p3", "x", "", "3", None)], "paper string, surface string, name string, ordinal string, country string")
    nodes, edges = fm.named_entities(named, "institution", "paper_has_institution", 0.98)
    assert [(r.node_id, r.country, len(r.aliases)) for r in nodes.collect()] == [("institution:university_of_harlow", "Spain", 2)] and edges.count() == 2


def test_inherited_background(spark):
    rows = [("s1", "a", "2 Related Work"), ("s2", "a", "2.1 Graph Methods"), ("s3", "a", "3 Methods"), ("s4", "b", "2.1 Evaluation"), ("s5", "b", "Results")]
    d = spark.createDataFrame(rows, "section string, paper string, title string")
    assert {r.section for r in background_sections(d).collect()} == {"s1", "s2"}
    roles = d.join(background_sections(d).withColumn("b", F.lit(True)), "section", "left").select("section", role_of(F.col("title"), F.lit(None).cast("string"), F.coalesce("b", F.lit(False))).alias("r"))
    assert {r.section: r.r for r in roles.collect()} == {"s1": "other", "s2": "other", "s3": "methods", "s4": "results", "s5": "results"}


def test_sources(spark, tmp_path):
    for paper in ("p1", ".hidden"):
        (tmp_path / paper).mkdir()
        (tmp_path / paper / "paragraphs.jsonl").write_text('{"item_index": 2, "text": "b"}\n{"text": "first"}\n')
        (tmp_path / paper / "images.jsonl").write_text('{"item_index": 1, "img_path": "x.png"}\n')
    got = cl.read_segments(spark, str(tmp_path)).collect()
    assert [(r.paper_id, r.item_index) for r in got] == [("p1", None), ("p1", 1), ("p1", 2)]
    files = spark.createDataFrame([("/d/p1/x_content_list.json",), ("/d/p1/content_list_v2.json",), ("/d/p2/content_list_v2.json",), ("/d/p3/other.json",)], "file string")
    assert {r.folder: r.file for r in cl.one_list_per_paper(files).collect()} == {"/d/p1": "/d/p1/x_content_list.json", "/d/p2": "/d/p2/content_list_v2.json"}
    manifests = spark.createDataFrame([("/d/p2", "C:\\old\\p2\\content_list_v2.json")], "folder string, path string")
    assert cl.manifest_paths(manifests, files).first().file == "/d/p2/content_list_v2.json"
    nested = spark.createDataFrame([((["a", None], {"k": "b\x00"}),)], "v struct<x: array<string>, y: map<string,string>>")
    assert nested.select(cl.flat_text(F.col("v"), nested.schema["v"].dataType).alias("t")).first().t == "a\nb"
    moved = cl.relative_paths(spark.createDataFrame([("file:///d/p1/x.png", 3)], "p string, n int"), "/d").first()
    assert (moved.p, moved.n) == ("p1/x.png", 3)
    log = spark.createDataFrame([("at /home/me/x and \\home\\me\\y",)], "t string")
    assert log.select(cl.without_local_paths(F.col("t"), {"/home/me": "<home>"}).alias("t")).first().t == "at <home>/x and <home>\\y"
