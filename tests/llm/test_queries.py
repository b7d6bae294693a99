"""Every query of the subpackage runs on the smallest tables; those with SQL agree with it."""

import duckdb
import pytest

from foliograph.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["rec_a", "rec_b"],
    "p2_found": ["src_table", "rec_id"],
    "p3_found": ["query_id", "node_id"],
    "p5_found": ["src_table", "rec_id", "defect"],
    "p6_found": ["node_id", "paper_id"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, root, name):
    c = duckdb.connect()
    for t in ("paper_content_list", "nodes", "size_limits", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, root).collect())) == sorted(c.execute(ORACLE_SQL[name]).fetchall())


def test_ranking_finds_the_expected_sections(spark):
    root = "/root/testdata/sf0.01"
    found = {tuple(r) for r in QUERIES["p3_found"](spark, root).collect()}
    want = set(duckdb.sql(f"SELECT query_id, unnest(expected_nodes) FROM '{root}/query_cases.parquet'").fetchall())
    assert len(found & want) >= 0.8 * len(want)
