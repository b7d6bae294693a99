from datetime import datetime as dt

import pytest

from foliograph.operators.references import orphan_counts, orphan_references

ROW = "edge_id string, kind string, s string, t string, at timestamp, state string"
NODE = "node_id string, born timestamp, died timestamp, side string"


def run(spark, rows, nodes, **more):
    return orphan_references(
        spark.createDataFrame(rows, ROW), spark.createDataFrame(nodes, NODE), row_key="edge_id", sides={"source": "s", "target": "t"},
        at="at", kind="kind", key="node_id", born="born", died="died", **more,
    )


NODES = [
    ("a", dt(2024, 1, 1), None, ""),
    ("b", dt(2024, 1, 1), dt(2024, 2, 1), ""),
    ("b", dt(2024, 3, 1), None, ""),
    ("late", dt(2024, 6, 1), None, ""),
    (None, dt(2024, 1, 1), None, ""),
]
ROWS = [
    ("e1", "k", "a", "b", dt(2024, 1, 15), "x"),
    ("e2", "k", "a", "b", dt(2024, 2, 15), "x"),
    ("e2", "k", "a", "b", dt(2024, 2, 15), "x"),
    ("e3", "k", "late", "none", dt(2024, 2, 15), "x"),
    ("e4", "k", None, "", dt(2024, 2, 15), "x"),
    ("e5", "k", "A", "b", dt(2024, 3, 2), "x"),
    ("e6", "k", "a", "a ", None, "x"),
]
WANT = {("e2", "target", "deleted"), ("e3", "source", "late"), ("e3", "target", "missing"), ("e5", "source", "missing"), ("e6", "source", "late"), ("e6", "target", "missing")}


@pytest.mark.parametrize("share", [1, 2000, 10**9])
def test_states(spark, share):
    got = run(spark, ROWS, NODES, heavy_share=share)
    assert {(r.edge_id, r.side, r.state) for r in got.collect()} == WANT
    assert sum(r.n_refs for r in orphan_counts(got, "kind", "at").collect()) == len(WANT)


def test_hot_orphan_and_empty_tables(spark):
    rows = [(f"e{i}", "k", "gone", "a", dt(2024, 2, 1), "") for i in range(300)]
    assert run(spark, rows, NODES).count() == 300
    assert run(spark, rows, []).count() == 600
    assert run(spark, [], NODES).count() == 0
