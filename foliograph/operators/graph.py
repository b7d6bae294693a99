"""Operators over a graph of nodes and edges: weights, shared entities, coupling, propagation, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean of two non-negative numbers, 0 if both are 0."""
    x, y = F.greatest(F.coalesce(a, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(b, F.lit(0.0)), F.lit(0.0))
    return F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0)


def best_edge(edges: DataFrame, group: list[str]) -> DataFrame:
    """The edge of highest confidence of each group; ties go to the smaller edge_id, nulls last."""
    first = F.min_by(F.struct("edge_id", "confidence"), F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.col("edge_id")))
    return edges.groupBy(*group).agg(first.alias("_b")).select(*group, "_b.edge_id", "_b.confidence")


def shared_entity_pairs(edges: DataFrame, specs: dict[str, tuple[str, float]], n_papers: int, least: int = 2, most: int = 10) -> DataFrame:
    """Unordered pairs of sources that share a target of 2 to `most` sources.

    Weight of one shared target: base * ln(1 + papers / group size) * harmonic mean of
    the confidences. The bounds on the group are part of the meaning (a target shared
    by many says nothing), so a hot target drops out before the self-join.
    """
    known = edges.where(F.col("edge_type").isin(list(specs))).where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    once = known.groupBy("edge_type", "target_id", "source_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("conf"))
    sizes = once.groupBy("edge_type", "target_id").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    members = once.join(sizes, ["edge_type", "target_id"])
    a, b = members.alias("a"), members.alias("b")
    base = F.create_map(*[F.lit(x) for k, (_, w) in specs.items() for x in (k, w)])
    name = F.create_map(*[F.lit(x) for k, (n, _) in specs.items() for x in (k, n)])
    pairs = a.join(b, (F.col("a.edge_type") == F.col("b.edge_type")) & (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.source_id") < F.col("b.source_id")))
    weight = base[F.col("a.edge_type")] * F.log1p(F.lit(float(n_papers)) / F.col("a.size")) * harmonic(F.col("a.conf"), F.col("b.conf"))
    return (
        pairs.select(F.col("a.source_id").alias("source_id"), F.col("b.source_id").alias("target_id"), name[F.col("a.edge_type")].alias("relation"), weight.alias("w"), harmonic(F.col("a.conf"), F.col("b.conf")).alias("h"))
        .groupBy("source_id", "target_id", "relation")
        .agg(F.round(F.sum("w"), 6).alias("weight"), F.round(F.max("h"), 6).alias("confidence"), F.count("*").alias("shared_count"))
    )


def pair_summaries(cross: DataFrame) -> DataFrame:
    """One row per unordered pair over all its relations."""
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    return cross.groupBy(a.alias("paper_a"), b.alias("paper_b")).agg(
        F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"),
        F.round(F.sum("weight"), 3).alias("total_weight"),
        F.count("*").alias("edge_count"),
        F.sum("shared_count").alias("shared_count"),
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges of one type between the same nodes as one: highest confidence, the last source, summed mentions."""
    return edges.groupBy("edge_type", "source_id", "target_id").agg(
        F.round(F.max("confidence"), 6).alias("confidence"),
        F.max_by("source", "edge_id").alias("source"),
        F.sum(F.coalesce("mention_count", F.lit(1))).cast("bigint").alias("mentions"),
        F.count("*").alias("n_edges"),
    )


def with_reverse(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, weight): edges in both directions, relations named with their end points' types."""
    typed = (
        edges.join(kinds.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("st")), "source_id")
        .join(kinds.select(F.col("node_id").alias("target_id"), F.col("node_type").alias("tt")), "target_id")
        .withColumn("relation", F.concat_ws(">", "st", "edge_type", "tt"))
    )
    back = typed.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.concat(F.lit("reverse:"), "relation").alias("relation"), "confidence")
    return typed.select("source_id", "target_id", "relation", "confidence").unionByName(back)


def normalized_weights(directed: DataFrame) -> DataFrame:
    """Confidence over the sum of its (target, relation), over the number of the target's active relations.

    Sums are aggregated first and joined back, so a hot target never fills a window.
    """
    sums = directed.groupBy("target_id", "relation").agg(F.sum("confidence").alias("s"))
    active = sums.groupBy("target_id").agg(F.greatest(F.count_if(F.col("s") > 0), F.lit(1)).alias("k"))
    return directed.join(sums, ["target_id", "relation"]).join(active, "target_id").withColumn("weight", F.col("confidence") / F.greatest("s", F.lit(1e-12)) / F.col("k"))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source_id, target_id, confidence, n): first.target = second.source, the weaker confidence counts, self-links left out."""
    a = first.select(F.col("source_id"), F.col("target_id").alias("mid"), F.col("confidence").alias("c1"))
    b = second.select(F.col("source_id").alias("mid"), F.col("target_id"), F.col("confidence").alias("c2"))
    return (
        a.join(b, "mid")
        .where(F.col("source_id") != F.col("target_id"))
        .groupBy("source_id", "target_id")
        .agg(F.round(F.max(F.least("c1", "c2")), 6).alias("confidence"), F.count("*").alias("n"))
    )


def propagate(anchors: DataFrame, cross: DataFrame, most: float = 4.0, least: float = 0.15) -> DataFrame:
    """Scores handed on from anchors (node, score) over symmetric cross edges.

    Boost: min(most, weight * (1 + .08 * min(shared, 6)) * confidence * score * .72), dropped
    below `least`; all boosts come from the same snapshot, so their order is free.
    """
    both = cross.select(F.col("source_id").alias("node"), F.col("target_id").alias("to"), "weight", "confidence", "shared_count").unionByName(
        cross.select(F.col("target_id").alias("node"), F.col("source_id").alias("to"), "weight", "confidence", "shared_count")
    )
    boost = F.least(F.lit(most), F.col("weight") * (1 + 0.08 * F.least("shared_count", F.lit(6))) * F.col("confidence") * F.col("score") * 0.72)
    return (
        both.join(anchors, "node")
        .withColumn("boost", boost)
        .where(F.col("boost") >= least)
        .groupBy(F.col("to").alias("node"))
        .agg(F.round(F.sum("boost"), 5).alias("boost"), F.count("*").alias("n_anchors"))
    )


def all_constraints(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Relational division: (query, source_id) of sources linked with a member of every group of the query.

    links: source_id, target_id; groups: query, grp, target_id.
    """
    need = groups.groupBy("query").agg(F.countDistinct("grp").alias("need"))
    have = links.join(groups, "target_id").groupBy("query", "source_id").agg(F.countDistinct("grp").alias("have"))
    return have.join(need, "query").where(F.col("have") == F.col("need")).select("query", "source_id", "have")


def dangling(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Edges whose `side` is no node at all."""
    return edges.join(nodes.select(F.col("node_id").alias(side)).distinct(), side, "left_anti")


def neighbours(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, source, target) of each row and the next one of its group."""
    w = W.partitionBy(group).orderBy(order, key)
    return rows.withColumn("next", F.lead(key).over(w)).where(F.col("next").isNotNull()).select(group, F.col(key).alias("source"), F.col("next").alias("target"))


def gated_messages(weighted: DataFrame, features: DataFrame, gates: DataFrame, matrices: DataFrame) -> DataFrame:
    """(node, dim, value): the sum over a node's edges of weight times gate times the relation's matrix times the source's features.

    weighted: source_id, target_id, relation, weight; features: node, dim, value; gates:
    relation, dim, gate; matrices: relation, i (to), j (from), w. Gates and matrices are
    parameters, a few rows per relation. Sources are transformed once per relation, and
    messages are summed before the shuffle, so a hot target is no single task.
    """
    used = weighted.select("source_id", "relation").distinct()
    turned = (
        used.join(features.select(F.col("node").alias("source_id"), F.col("dim").alias("j"), "value"), "source_id")
        .join(matrices, ["relation", "j"])
        .groupBy("source_id", "relation", F.col("i").alias("dim"))
        .agg(F.sum(F.col("value") * F.col("w")).alias("h"))
    )
    sent = weighted.join(turned, ["source_id", "relation"]).join(gates, ["relation", "dim"])
    return sent.groupBy(F.col("target_id").alias("node"), "dim").agg(F.sum(F.col("weight") * F.col("gate") * F.col("h")).alias("value"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(node, dim, value) with each node's vector at length 1; vectors of length 0 stay."""
    norms = vectors.groupBy("node").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    return vectors.join(norms, "node").select("node", "dim", (F.col("value") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("value"))


def residual(features: DataFrame, delta: DataFrame, scale: float = 0.25) -> DataFrame:
    """(node, dim, value): features plus `scale` times the delta at length 1, brought to length 1 again."""
    both = features.unionByName(unit_rows(delta).select("node", "dim", (F.col("value") * scale).alias("value")))
    known = both.groupBy("node", "dim").agg(F.sum("value").alias("value")).join(features.select("node").distinct(), "node", "left_semi")
    return unit_rows(known)
