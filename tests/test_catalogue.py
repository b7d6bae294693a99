"""Every registered query runs on the smallest tables, and those with SQL agree with it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "embeddings papers nodes edges paper_content_list retrieval_scores query_cases documents doc_labels scan_samples size_limits".split()
CORE = [n for n in entry.catalogue.ORACLE_SQL]


#: queries that find nothing in the smallest tables
NONE_THERE = {"section_mentions"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([_norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, root, name):
    df = entry.queries()[name](spark, root)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    got = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(tuple(_norm(r[names.index(x)]) for x in columns) for r in got.fetchall())
    assert sorted(tuple(_norm(x) for x in r) for r in df.select(columns).collect()) == want


@pytest.mark.parametrize("name", [n for n in entry.catalogue.QUERIES if n not in entry.catalogue.ORACLE_SQL])
def test_runs(spark, root, name):
    """Rows are there, and distinct but for what may repeat."""
    df = entry.queries()[name](spark, root)
    rows = df.collect()
    assert (rows or name in NONE_THERE) and len(set(df.columns)) == len(df.columns)
    assert len({str(r) for r in rows}) >= 0.9 * len(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
