"""Queries of the general data-processing operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.operators.packed_values import explode_packed
from foliograph.operators.references import orphan_counts, orphan_references
from foliograph.sources.store import table


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    edges = table(spark, root, "edges").select("edge_id", "edge_type", "source_id", "target_id", "ingested_at")
    nodes = table(spark, root, "nodes").select("node_id", "ingested_at", "deleted_at")
    return orphan_references(
        edges,
        nodes,
        row_key="edge_id",
        sides={"source": "source_id", "target": "target_id"},
        at="ingested_at",
        kind="edge_type",
        key="node_id",
        born="ingested_at",
        died="deleted_at",
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references of edges with their state."""
    return _orphans(spark, root).select("edge_id", "side", "state").distinct()


def p4_orphans_by_month(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per kind of edge, month, side and state."""
    return orphan_counts(_orphans(spark, root), "edge_type", "ingested_at")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Every name in the packed author fields with its position."""
    nodes = table(spark, root, "nodes").select("node_id", "author_text", "citation_author_text")
    return explode_packed(nodes, "node_id", ["author_text", "citation_author_text"])


QUERIES = {"p4_found": p4_found, "p4_orphans_by_month": p4_orphans_by_month, "p7_found": p7_found}

_ORPHANS = """
WITH refs AS (
  SELECT DISTINCT edge_id, edge_type, side, ref, seen FROM (
    SELECT edge_id, edge_type, 'source' AS side, source_id AS ref, ingested_at AS seen FROM edges
    UNION ALL
    SELECT edge_id, edge_type, 'target' AS side, target_id AS ref, ingested_at AS seen FROM edges) x
  WHERE ref IS NOT NULL AND ref <> ''),
judged AS (
  SELECT r.edge_id, r.edge_type, r.side, r.ref, r.seen, count(n.node_id) AS n_rows,
    count(CASE WHEN n.ingested_at <= r.seen AND (n.deleted_at IS NULL OR n.deleted_at > r.seen) THEN 1 END) AS n_live,
    count(CASE WHEN n.ingested_at <= r.seen THEN 1 END) AS n_begun
  FROM refs r LEFT JOIN nodes n ON n.node_id = r.ref
  GROUP BY r.edge_id, r.edge_type, r.side, r.ref, r.seen),
orphans AS (
  SELECT *, CASE WHEN n_rows = 0 THEN 'missing' WHEN n_begun = 0 THEN 'late' ELSE 'deleted' END AS state
  FROM judged WHERE n_live = 0)
"""

ORACLE_SQL = {
    "p4_found": _ORPHANS + "SELECT DISTINCT edge_id, side, state FROM orphans",
    "p4_orphans_by_month": _ORPHANS
    + "SELECT edge_type, strftime(seen, '%Y-%m') AS month, side, state, count(*) AS n_refs, count(DISTINCT ref) AS n_keys "
    "FROM orphans GROUP BY 1, 2, 3, 4",
}
