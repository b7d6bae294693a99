"""Queries over the structure of papers, mentions in their texts, layers over the graph, windows and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import graph as g
from foliograph.operators import semantic, windows
from foliograph.operators.ranking import competition_recall
from foliograph.operators.structure import chunk_papers
from foliograph.plans.graph_queries import _DIRECTED, _RECALL_EDGES, _edges, _weighted
from foliograph.plans.registry import registry
from foliograph.sources.store import table

QUERIES, ORACLE_SQL, query = registry()


def _label(c: str) -> str:
    return f"""regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(regexp_extract({c}, '^\\s*((?:figure|fig\\.?|table|tab\\.?|chart)\\s*\\.?\\s*\\d+[A-Za-z]?)\\b', 1, 'i')), '.', ' '), '\\s+', ' ', 'g')), '^(?:fig|chart) ', 'figure '), '^tab ', 'table ')"""


_NEAR = f"""WITH f AS (SELECT DISTINCT block_id AS figure, paper_id, item_index AS fi, coalesce(page_idx, 0) AS fp, {_label("array_to_string(image_caption, ' ')")} AS label FROM paper_content_list WHERE type IN ('image', 'table', 'chart') AND paper_id IS NOT NULL),
b AS (SELECT DISTINCT block_id AS block, paper_id, item_index AS bi, coalesce(page_idx, 0) AS bp, lower(text) AS txt FROM paper_content_list WHERE type IN ('text', 'paragraph') AND text_level IS NULL AND sub_type IS NULL AND length(trim(text)) > 0),
j AS (SELECT figure, block, bi, abs(bp - fp) AS dp, abs(bi - fi) AS di, coalesce(label <> '' AND regexp_matches(txt, '(^|[^a-z0-9])' || label || '($|[^a-z0-9])'), FALSE) AS named FROM f JOIN b USING (paper_id)),
a AS (SELECT *, max(named::INT) OVER (PARTITION BY figure) AS anyn FROM j),
r AS (SELECT figure, block, named, row_number() OVER (PARTITION BY figure ORDER BY CASE WHEN anyn = 1 THEN 0 ELSE dp END, CASE WHEN anyn = 1 THEN bi ELSE di END, bi, block) AS place FROM a WHERE named OR anyn = 0)
"""


def _figure_blocks(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "paper_content_list")
    page = F.coalesce("page_idx", F.lit(0))
    f = t.where(F.col("type").isin("image", "table", "chart") & F.col("paper_id").isNotNull())
    f = f.select(F.col("block_id").alias("figure"), "paper_id", F.col("item_index").alias("fi"), page.alias("fp"), F.coalesce(tx.reference_label(F.array_join("image_caption", " ")), F.lit("")).alias("label")).distinct()
    b = t.where(F.col("type").isin("text", "paragraph") & F.col("text_level").isNull() & F.col("sub_type").isNull() & (F.length(F.trim("text")) > 0))
    b = b.select(F.col("block_id").alias("block"), "paper_id", F.col("item_index").alias("bi"), page.alias("bp"), F.lower("text").alias("txt")).distinct()
    named = (F.col("label") != "") & F.regexp_like("txt", F.concat(F.lit("(^|[^a-z0-9])"), F.col("label"), F.lit("($|[^a-z0-9])")))
    return f.join(b, "paper_id").select("figure", "block", "bi", F.abs(F.col("bp") - F.col("fp")).alias("dp"), F.abs(F.col("bi") - F.col("fi")).alias("di"), F.coalesce(named, F.lit(False)).alias("named"))


@query(_NEAR + "SELECT figure, block, CASE WHEN named THEN 'reference_label' ELSE 'nearby_text' END AS source, CASE WHEN named THEN 0.96 ELSE greatest(0.72, 0.90 - 0.08 * (place - 1)) END::DOUBLE AS confidence FROM r WHERE place <= 2")
def figure_descriptions(spark: SparkSession, root: str) -> DataFrame:
    """The two blocks that describe each figure: those that name its label, else the nearest ones."""
    j = _figure_blocks(spark, root)
    told = j.groupBy("figure").agg(F.max("named").alias("_any"))
    pool = j.join(told, "figure").where(F.col("named") | ~F.col("_any"))
    first, second = F.when(F.col("_any"), 0).otherwise(F.col("dp")), F.when(F.col("_any"), F.col("bi")).otherwise(F.col("di"))
    ranked = pool.withColumn("place", F.row_number().over(W.partitionBy("figure").orderBy(first, second, "bi", "block"))).where(F.col("place") <= 2)
    conf = F.when(F.col("named"), 0.96).otherwise(F.greatest(F.lit(0.72), F.round(0.90 - 0.08 * (F.col("place") - 1), 6)))
    return ranked.select("figure", "block", F.when(F.col("named"), "reference_label").otherwise("nearby_text").alias("source"), conf.alias("confidence"))


@query(
    f"""WITH f AS (SELECT DISTINCT node_id AS figure, paper_id, page_start AS fp, {_label("array_to_string(caption, ' ')")} AS label FROM nodes WHERE node_type = 'figure' AND caption IS NOT NULL),
s AS (SELECT DISTINCT node_id AS section, paper_id, page_start AS sp, node_order, lower(section_text) AS txt FROM nodes WHERE node_type = 'section' AND section_text IS NOT NULL),
own AS (SELECT target_id AS figure, min(source_id) AS was FROM edges WHERE edge_type = 'section_has_figure' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
h AS (SELECT figure, section, abs(sp - fp) AS gap, node_order FROM f JOIN s USING (paper_id) WHERE label <> '' AND regexp_matches(txt, '(^|[^a-z0-9])' || label || '($|[^a-z0-9])')),
q AS (SELECT h.*, was FROM h JOIN own USING (figure) WHERE figure NOT IN (SELECT figure FROM h JOIN own USING (figure) WHERE section = was))
SELECT figure, was, section, gap FROM (SELECT *, row_number() OVER (PARTITION BY figure ORDER BY gap, node_order, section) AS k FROM q WHERE gap <= 1) x WHERE k = 1"""
)
def reassigned_figures(spark: SparkSession, root: str) -> DataFrame:
    """Figures that no text of their own section names, with the nearest section within a page that does."""
    n = table(spark, root, "nodes")
    f = n.where((F.col("node_type") == "figure") & F.col("caption").isNotNull()).select(F.col("node_id").alias("figure"), "paper_id", F.col("page_start").alias("fp"), tx.reference_label(F.array_join("caption", " ")).alias("label")).where(F.col("label") != "").distinct()
    s = n.where((F.col("node_type") == "section") & F.col("section_text").isNotNull()).select(F.col("node_id").alias("section"), "paper_id", F.col("page_start").alias("sp"), "node_order", F.lower("section_text").alias("txt")).distinct()
    named = F.regexp_like("txt", F.concat(F.lit("(^|[^a-z0-9])"), F.col("label"), F.lit("($|[^a-z0-9])")))
    hits = f.join(s, "paper_id").where(named).select("figure", "section", F.abs(F.col("sp") - F.col("fp")).alias("gap"), "node_order")
    e = table(spark, root, "edges").where((F.col("edge_type") == "section_has_figure") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    own = e.groupBy(F.col("target_id").alias("figure")).agg(F.min("source_id").alias("was"))
    known = hits.join(own, "figure")
    told = known.where(F.col("section") == F.col("was")).select("figure").distinct()
    best = known.join(told, "figure", "left_anti").where(F.col("gap") <= 1).groupBy("figure", "was").agg(F.min(F.struct("gap", "node_order", "section")).alias("b"))
    return best.select("figure", "was", "b.section", "b.gap")


def _numbered_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks with the number of their section, which grows by one whenever the path changes."""
    c = chunk_papers(table(spark, root, "paper_content_list"))
    path = F.array_join("section_path", "␟")
    before = F.lag(path).over(W.partitionBy("paper_id").orderBy("chunk_no"))
    moved = c.withColumn("_new", F.when(before.isNull() | (before != path), 1).otherwise(0))
    return moved.withColumn("section_no", F.sum("_new").over(W.partitionBy("paper_id").orderBy("chunk_no"))).drop("_new")


def _ids(c: DataFrame) -> DataFrame:
    chunk = F.concat(F.lit("chunk:"), "paper_id", F.lit(":"), F.lpad(F.col("chunk_no").cast("string"), 4, "0"))
    section = F.concat(F.lit("section:"), "paper_id", F.lit(":"), F.lpad(F.col("section_no").cast("string"), 3, "0"))
    return c.withColumn("chunk", chunk).withColumn("section", section)


@query()
def structure_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of papers, sections and chunks as the blocks tell them: what holds what, and what comes next (tested by its invariants)."""
    c = _ids(_numbered_chunks(spark, root))
    sections = c.select("paper_id", "section_no", "section").distinct()
    edge = lambda df, kind, a, b: df.where(F.col(b).isNotNull()).select(F.lit(kind).alias("edge_type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(1.0).alias("confidence"))
    paper = F.concat(F.lit("paper:"), "paper_id")
    out = edge(sections.withColumn("paper", paper), "paper_has_section", "paper", "section")
    out = out.unionByName(edge(c, "section_has_chunk", "section", "chunk"))
    out = out.unionByName(edge(sections.withColumn("next", F.lead("section").over(W.partitionBy("paper_id").orderBy("section_no"))), "section_next", "section", "next"))
    return out.unionByName(edge(c.withColumn("next", F.lead("chunk").over(W.partitionBy("paper_id").orderBy("chunk_no"))), "chunk_next", "chunk", "next"))


@query()
def section_texts(spark: SparkSession, root: str) -> DataFrame:
    """Sections with the text of their chunks in order and its first 420 characters (tested by its invariants)."""
    c = _ids(_numbered_chunks(spark, root))
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "text")))
    s = c.groupBy("paper_id", "section").agg(F.element_at(F.first("section_path"), -1).alias("title"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return s.select("*", tx.preview("text", 420).alias("summary"))


def _vocabulary(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nodes").where(F.col("node_type").isin("method", "dataset", "task", "metric", "model") & F.col("canonical_name").isNotNull())
    return n.select(F.col("node_type").alias("kind"), F.col("canonical_name").alias("name"), F.col("canonical_name").alias("alias")).distinct()


def _section_rows(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "nodes").where(F.col("node_type") == "section").groupBy("node_id").agg(*[F.max(c).alias(c) for c in ("paper_id", "section_title", "section_group", "section_text", "node_order")])
    return s.select(F.col("node_id").alias("key"), "paper_id", "section_title", "section_group", "node_order", tx.join_unique("section_title", "section_text").alias("text"))


def _section_edges(spark: SparkSession, root: str) -> DataFrame:
    rows = _section_rows(spark, root)
    found = semantic.extract(rows, _vocabulary(spark, root)).where(F.col("confidence") >= 0.72).join(rows, "key")
    method = F.col("kind") == "method"
    keep = ~method | (semantic.keeps_method(F.col("name"), F.col("source"), F.col("section_group"), F.col("section_title"), False) & ~semantic.comparison_only(F.col("text"), F.col("surface")))
    return semantic.mention_edges(found.where(keep), 0)


@query()
def mention_edges(spark: SparkSession, root: str) -> DataFrame:
    """What sections use, address and report, read off their texts (tested against small texts)."""
    return _section_edges(spark, root)


@query()
def paper_mention_edges(spark: SparkSession, root: str) -> DataFrame:
    """What papers use, address and report, by the mentions in their sections and figures."""
    edges = _section_edges(spark, root)
    n = table(spark, root, "nodes")
    f = n.where((F.col("node_type") == "figure") & (F.size("caption") > 0)).groupBy(F.col("node_id").alias("key")).agg(F.max("paper_id").alias("paper_id"), F.max(F.array_join("caption", "\n")).alias("text"))
    seen = semantic.extract(f.withColumn("section_group", F.lit("results")), _vocabulary(spark, root), figures=True).where(F.col("confidence") >= 0.80)
    keep = (F.col("kind") != "method") | semantic.keeps_method(F.col("name"), F.col("source"), F.lit("results"), F.lit(""), True)
    edges = edges.unionByName(semantic.mention_edges(seen.where(keep), 2))
    owners = n.where(F.col("node_type").isin("section", "figure") & F.col("paper_id").isNotNull()).select(F.col("node_id").alias("node"), F.concat(F.lit("paper:"), "paper_id").alias("paper")).distinct()
    return semantic.promoted(edges, owners)


@query()
def mention_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The sections of a paper that hold what is said of it in its title and abstract, else its first ones."""
    p = table(spark, root, "papers").select(F.col("node_id").alias("key"), tx.join_unique("title", "abstract", F.array_join("keywords", "; ")).alias("text")).withColumn("section_group", F.lit("abstract")).dropDuplicates(["key"])
    found = semantic.extract(p, _vocabulary(spark, root)).where(F.col("confidence") >= 0.78)
    records = _section_rows(spark, root).select(F.concat(F.lit("paper:"), "paper_id").alias("source_id"), F.col("key").alias("record"), F.col("node_order").alias("record_order"), "text")
    return semantic.evidence(semantic.mention_edges(found, 1), records, 2)


_FEATURES = """, deg AS (SELECT node_id, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT node_id FROM nodes WHERE node_id IS NOT NULL) n
  LEFT JOIN (SELECT source_id AS node_id, count(*) AS n FROM typed GROUP BY 1) o USING (node_id) LEFT JOIN (SELECT target_id AS node_id, count(*) AS n FROM typed GROUP BY 1) i USING (node_id)
  LEFT JOIN (SELECT source_id AS node_id, avg(confidence) AS c FROM typed GROUP BY 1) c USING (node_id)),
fl AS (SELECT node_id AS node, 0 AS dim, ln(1 + o) AS value FROM deg UNION ALL SELECT node_id, 1, ln(1 + i) FROM deg UNION ALL SELECT node_id, 2, c FROM deg),
feat AS (SELECT node, dim, value / CASE WHEN n > 0 THEN n ELSE 1 END AS value FROM fl JOIN (SELECT node, sqrt(sum(value * value)) AS n FROM fl GROUP BY 1) x USING (node)),
msg AS (SELECT w.target_id AS node, CASE WHEN w.relation LIKE 'reverse:%' AND f.dim < 2 THEN 1 - f.dim ELSE f.dim END AS dim, sum(w.weight * CASE WHEN w.relation LIKE 'reverse:%' THEN 0.5 ELSE 1 END * f.value) AS value FROM weighted w JOIN feat f ON f.node = w.source_id GROUP BY 1, 2)
"""


def _node_features(spark: SparkSession, root: str) -> DataFrame:
    """(node, dim, value) at length 1: how many edges leave and reach a node, and how sure they are."""
    nodes = table(spark, root, "nodes").where(F.col("node_id").isNotNull()).select("node_id", "node_type").distinct()
    kinds = nodes.select("node_id", "node_type")
    e = _edges(spark, root).where(F.col("confidence").isNotNull())
    typed = e.join(kinds.select(F.col("node_id").alias("source_id")), "source_id").join(kinds.select(F.col("node_id").alias("target_id")), "target_id")
    out = typed.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("o"), F.avg("confidence").alias("c"))
    into = typed.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("i"))
    d = nodes.select("node_id").distinct().join(out, "node_id", "left").join(into, "node_id", "left")
    value = F.array(F.log1p(F.coalesce("o", F.lit(0))), F.log1p(F.coalesce("i", F.lit(0))), F.coalesce("c", F.lit(0.0)))
    return g.unit_rows(d.select(F.col("node_id").alias("node"), F.posexplode(value).alias("dim", "value")))


def _messages(spark: SparkSession, root: str) -> DataFrame:
    weighted = _weighted(spark, root)
    relations = weighted.select("relation").distinct()
    back = F.col("relation").startswith("reverse:")
    gates = relations.select("relation", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("dim"), F.when(back, 0.5).otherwise(1.0).alias("gate"))
    pairs = F.when(back, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (2, 2))])).otherwise(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i).alias("j")) for i in range(3)]))
    matrices = relations.select("relation", F.explode(pairs).alias("p")).select("relation", "p.i", "p.j", F.lit(1.0).alias("w"))
    return g.gated_messages(weighted, _node_features(spark, root), gates, matrices)


@query(_DIRECTED + _FEATURES + "SELECT node, dim, round(value, 5) AS value FROM msg")
def message_pass(spark: SparkSession, root: str) -> DataFrame:
    """One step of messages along all relations, each with its weight, gate and matrix."""
    return _messages(spark, root).select("node", "dim", F.round("value", 5).alias("value"))


@query(
    _DIRECTED
    + _FEATURES
    + """, del AS (SELECT node, dim, value / CASE WHEN n > 0 THEN n ELSE 1 END AS value FROM msg JOIN (SELECT node, sqrt(sum(value * value)) AS n FROM msg GROUP BY 1) x USING (node)),
sm AS (SELECT f.node, f.dim, f.value + 0.25 * coalesce(d.value, 0) AS value FROM feat f LEFT JOIN del d ON d.node = f.node AND d.dim = f.dim)
SELECT node, dim, round(value / CASE WHEN n > 0 THEN n ELSE 1 END, 5) AS value FROM sm JOIN (SELECT node, sqrt(sum(value * value)) AS n FROM sm GROUP BY 1) y USING (node)"""
)
def encoded_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of nodes after one layer: their features and a quarter of the messages, at length 1."""
    return g.residual(_node_features(spark, root), _messages(spark, root)).select("node", "dim", F.round("value", 5).alias("value"))


@query(
    """SELECT node_type, count(*) AS n, CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS BIGINT) AS high, CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS BIGINT) AS low
FROM (SELECT DISTINCT node_id, node_type, sha256(concat_ws('|', node_id, node_type, coalesce(canonical_name, ''), coalesce(title, ''), coalesce(section_text, ''))) AS h FROM nodes WHERE node_id <> '') x GROUP BY 1"""
)
def graph_signature(spark: SparkSession, root: str) -> DataFrame:
    """A signature of the nodes of each type that any change of a text changes: sums over SHA-256, so the order is free and parts can be merged."""
    none = F.lit("")
    text = F.concat_ws("|", "node_id", "node_type", *[F.coalesce(c, none) for c in ("canonical_name", "title", "section_text")])
    rows = table(spark, root, "nodes").where(F.col("node_id") != "").select("node_id", "node_type", F.sha2(text, 256).alias("h")).distinct()
    part = lambda at: F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("bigint"))
    return rows.groupBy("node_type").agg(F.count("*").alias("n"), part(1).alias("high"), part(9).alias("low"))


@query(
    """WITH v AS (SELECT vec_id, embedding, len(embedding) AS n, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT 'repeated ids' AS rule, count(*) AS n FROM (SELECT vec_id FROM v GROUP BY 1 HAVING count(*) > 1) x UNION ALL SELECT 'other length', count(*) FROM v WHERE n <> (SELECT max(n) FROM v)
UNION ALL SELECT 'not finite', count(*) FROM v WHERE isnan(l) OR isinf(l) UNION ALL SELECT 'zero', count(*) FROM v WHERE l = 0 UNION ALL SELECT 'not of length 1', count(*) FROM v WHERE abs(l - 1) > 1e-3"""
)
def vector_audit(spark: SparkSession, root: str) -> DataFrame:
    """How many vectors of an index break each rule."""
    v = table(spark, root, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("l"))
    most = v.agg(F.max("n").alias("most"))
    rules = {"not finite": F.isnan("l") | (F.col("l") == float("inf")), "zero": F.col("l") == 0, "not of length 1": F.abs(F.col("l") - 1) > 1e-3}
    out = v.groupBy("vec_id").count().where(F.col("count") > 1).agg(F.count("*").alias("n")).select(F.lit("repeated ids").alias("rule"), "n")
    out = out.unionByName(v.join(F.broadcast(most), F.col("n") != F.col("most")).agg(F.count("*").alias("n")).select(F.lit("other length").alias("rule"), "n"))
    for rule, broken in rules.items():
        out = out.unionByName(v.where(broken).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return out


_ABLATED = f"""WITH best AS (SELECT kind, paper, max(score) AS score FROM {_RECALL_EDGES} WHERE score > 0 AND kind IN ('method', 'dataset', 'model', 'metric') GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY score DESC) AS rnk FROM best),
w AS (SELECT paper, kind, CASE kind WHEN 'method' THEN 1.0 WHEN 'dataset' THEN 0.75 ELSE 0.5 END::DOUBLE / (60 + rnk) AS c FROM r WHERE rnk <= 50)
SELECT paper, round(sum(c), 8) AS total, round(coalesce(sum(c) FILTER (WHERE kind <> 'method'), 0), 8) AS without FROM w GROUP BY 1 HAVING count(CASE WHEN kind = 'method' THEN 1 END) > 0"""


@query(_ABLATED)
def channel_ablation(spark: SparkSession, root: str) -> DataFrame:
    """Recall of papers with and without the channel of methods, of papers that it reaches."""
    e = _edges(spark, root).where(F.col("edge_type").startswith("paper_uses_") & F.col("confidence").isNotNull() & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    scores = e.select(F.lit("all").alias("query"), F.substring_index("target_id", ":", 1).alias("kind"), F.col("source_id").alias("paper"), F.col("confidence").alias("score"))
    weights = {"method": 1.0, "dataset": 0.75, "model": 0.5, "metric": 0.5}
    full = competition_recall(scores, weights=weights, limit=50).select("paper", "total")
    rest = competition_recall(scores, weights={k: v for k, v in weights.items() if k != "method"}, limit=50).select("paper", F.col("total").alias("without"))
    own = competition_recall(scores, weights={"method": 1.0}, limit=50).select("paper")
    return full.join(own, "paper", "left_semi").join(rest, "paper", "left").select("paper", "total", F.coalesce("without", F.lit(0.0)).alias("without"))


_IMAGES = "(SELECT DISTINCT CAST(block_id AS VARCHAR) AS image, CAST(ceil(bbox[3] - bbox[1]) AS INT) + 16 AS width, CAST(ceil(bbox[4] - bbox[2]) AS INT) + 16 AS height FROM paper_content_list WHERE len(bbox) = 4 AND img_path IS NOT NULL AND bbox[3] > bbox[1] AND bbox[4] > bbox[2])"
_SCALES = ", ".join(f"({i}, {w}::DOUBLE, {h}::DOUBLE)" for i, (w, h) in enumerate(windows.SCALES))
_ANCHORS = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(windows.ANCHORS))


def _images(spark: SparkSession, root: str) -> DataFrame:
    """Image blocks with a margin of eight around their content."""
    b = F.col("bbox")
    rows = table(spark, root, "paper_content_list").where((F.size(b) == 4) & F.col("img_path").isNotNull() & (b[2] > b[0]) & (b[3] > b[1]))
    size = rows.select(F.col("block_id").cast("string").alias("image"), (F.ceil(b[2] - b[0]) + 16).cast("int").alias("width"), (F.ceil(b[3] - b[1]) + 16).cast("int").alias("height")).distinct()
    return size.select("*", F.lit(8).alias("cx0"), F.lit(8).alias("cy0"), (F.col("width") - 8).alias("cx1"), (F.col("height") - 8).alias("cy1"))


@query(
    f"""WITH i AS {_IMAGES}, s(si, sw, sh) AS (VALUES {_SCALES}), ax(axi, ax) AS (VALUES {_ANCHORS}), ay(ayi, ay) AS (VALUES {_ANCHORS}),
w AS (SELECT *, least(width - 16, greatest(32, CAST(round_even((width - 16) * sw, 0) AS INT))) AS w, least(height - 16, greatest(32, CAST(round_even((height - 16) * sh, 0) AS INT))) AS h FROM i, s, ax, ay),
b AS (SELECT image, width, height, si * 100 + axi * 10 + ayi AS turn, 8 + CAST(round_even((width - 16 - w) * ax, 0) AS INT) AS x0, 8 + CAST(round_even((height - 16 - h) * ay, 0) AS INT) AS y0, w, h FROM w),
r AS (SELECT image, width, height, x0, y0, x0 + w AS x1, y0 + h AS y1, min(turn) AS turn FROM b WHERE NOT (x0 = 8 AND y0 = 8 AND w = width - 16 AND h = height - 16) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY image) AS n FROM r),
m AS (SELECT *, least(n, 358) AS m FROM o),
k AS (SELECT DISTINCT image, CAST(trunc(j * (n - 1) / greatest(m - 1, 1)::DOUBLE + 1e-9) AS BIGINT) AS p FROM (SELECT image, n, m, unnest(range(0, m)) AS j FROM (SELECT DISTINCT image, n, m FROM m) u) v)
SELECT image, turn + 10 AS no, x0, y0, x1, y1 FROM m JOIN k USING (image, p) UNION ALL SELECT image, 0, 0, 0, width, height FROM i UNION ALL SELECT image, 1, 8, 8, width - 8, height - 8 FROM i"""
)
def candidate_windows(spark: SparkSession, root: str) -> DataFrame:
    """At most 360 windows of every image, of 28 scales at 81 places."""
    return windows.candidate_windows(_images(spark, root))


@query()
def kept_windows(spark: SparkSession, root: str) -> DataFrame:
    """The windows of each page kept out of its images, larger ones first, within the budget of area (tested against small cases)."""
    b = F.col("bbox")
    t = table(spark, root, "paper_content_list").where((F.size(b) == 4) & F.col("img_path").isNotNull() & F.col("page_idx").isNotNull())
    page = F.concat_ws("#", "paper_id", "page_idx")
    boxes = t.select(page.alias("image"), F.col("block_id").alias("no"), *[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).distinct()
    wide, high = F.greatest(F.max("x1"), F.lit(1.0)), F.greatest(F.max("y1"), F.lit(1.0))
    size = boxes.groupBy("image").agg(wide.alias("w"), high.alias("h"))
    unit = boxes.join(size, "image").select("image", "no", (F.col("x0") / F.col("w")).alias("x0"), (F.col("y0") / F.col("h")).alias("y0"), (F.col("x1") / F.col("w")).alias("x1"), (F.col("y1") / F.col("h")).alias("y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return windows.choose_windows(unit.withColumn("score", windows.retain_score(F.sqrt(F.greatest(area, F.lit(0.0))), F.lit(0.0), area)))
