"""Queries over the document-entity graph, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import graph as g
from foliograph.operators import ranking as rk
from foliograph.operators.tfidf import ngram_counts, rank_documents
from foliograph.sources.store import row_bound, table

#: fixed values: shared-entity relations and their base weights
SHARED = {
    "paper_has_author": ("paper_shares_author", 3.0),
    "paper_has_institution": ("paper_shares_institution", 1.4),
    "paper_published_in": ("paper_shares_venue", 1.0),
    "paper_uses_method": ("paper_shares_method", 2.2),
    "paper_uses_dataset": ("paper_shares_dataset", 2.4),
    "paper_uses_model": ("paper_shares_model", 1.8),
}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "edges").select("edge_id", "edge_type", "source_id", "target_id", "confidence", "source", "mention_count").distinct()


def _nodes(spark: SparkSession, root: str, kind: str, *columns: str) -> DataFrame:
    return table(spark, root, "nodes").where(F.col("node_type") == kind).select("node_id", *columns).distinct()


def _n_papers(spark: SparkSession, root: str) -> int:
    return row_bound(table(spark, root, "papers").select("paper_id").distinct())


_E = "(SELECT DISTINCT edge_id, edge_type, source_id, target_id, confidence, source, mention_count FROM edges) e"
_SPECS = " UNION ALL ".join(f"SELECT '{k}' AS edge_type, '{n}' AS relation, CAST({w} AS DOUBLE) AS base" for k, (n, w) in SHARED.items())
_CROSS = f"""WITH specs AS ({_SPECS}),
once AS (SELECT edge_type, target_id, source_id, max(coalesce(confidence, 0)) AS conf FROM edges
  WHERE edge_type IN (SELECT edge_type FROM specs) AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2, 3),
sized AS (SELECT *, count(*) OVER (PARTITION BY edge_type, target_id) AS size FROM once),
members AS (SELECT * FROM sized WHERE size BETWEEN 2 AND 10),
pairs AS (SELECT a.source_id, b.source_id AS target_id, s.relation, s.base, a.size,
    CASE WHEN a.conf + b.conf > 0 THEN 2 * a.conf * b.conf / (a.conf + b.conf) ELSE 0 END AS h
  FROM members a JOIN members b ON a.edge_type = b.edge_type AND a.target_id = b.target_id AND a.source_id < b.source_id
  JOIN specs s ON s.edge_type = a.edge_type),
crossed AS (SELECT source_id, target_id, relation,
    round(sum(base * ln(1 + (SELECT count(DISTINCT paper_id) FROM papers) / size::DOUBLE) * h), 6) AS weight,
    round(max(h), 6) AS confidence, count(*) AS shared_count FROM pairs GROUP BY 1, 2, 3)
"""


def _cross(spark: SparkSession, root: str) -> DataFrame:
    return g.shared_entity_pairs(_edges(spark, root), SHARED, _n_papers(spark, root))


@query(_CROSS + "SELECT * FROM crossed")
def shared_entity_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Papers that share an author, institution, venue, method, dataset or model."""
    return _cross(spark, root)


@query(
    _CROSS
    + """SELECT least(source_id, target_id) AS paper_a, greatest(source_id, target_id) AS paper_b,
string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, round(sum(weight), 3) AS total_weight,
count(*) AS edge_count, CAST(sum(shared_count) AS BIGINT) AS shared_count FROM crossed GROUP BY 1, 2"""
)
def pair_rollup(spark: SparkSession, root: str) -> DataFrame:
    """All relations of two papers in one row."""
    return g.pair_summaries(_cross(spark, root))


@query(f"SELECT edge_type, source, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM {_E} GROUP BY 1, 2")
def edge_counts(spark: SparkSession, root: str) -> DataFrame:
    """Edges per type and source."""
    return _edges(spark, root).groupBy("edge_type", "source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT node_type, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes FROM nodes GROUP BY 1")
def node_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows and nodes per type."""
    return table(spark, root, "nodes").groupBy("node_type").agg(F.count("*").alias("n_rows"), F.countDistinct("node_id").alias("n_nodes"))


@query(
    f"""SELECT source_id, edge_type, edge_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id, edge_type
ORDER BY coalesce(confidence, -1) DESC, edge_id) AS k FROM {_E} WHERE source_id IS NOT NULL) x WHERE k = 1"""
)
def best_edge_per_source(spark: SparkSession, root: str) -> DataFrame:
    """The most certain edge of each source and type."""
    return g.best_edge(_edges(spark, root).where(F.col("source_id").isNotNull()), ["source_id", "edge_type"])


@query(
    f"""SELECT edge_type, source_id, target_id, round(max(confidence), 6) AS confidence, arg_max(source, edge_id) AS source,
CAST(sum(coalesce(mention_count, 1)) AS BIGINT) AS mentions, count(*) AS n_edges FROM {_E} GROUP BY 1, 2, 3"""
)
def merged_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges between the same nodes as one."""
    return g.merge_edges(_edges(spark, root))


_DIRECTED = f"""WITH kinds AS (SELECT DISTINCT node_id, node_type FROM nodes),
typed AS (SELECT e.source_id, e.target_id, s.node_type || '>' || e.edge_type || '>' || t.node_type AS relation, e.confidence
  FROM {_E} JOIN kinds s ON s.node_id = e.source_id JOIN kinds t ON t.node_id = e.target_id WHERE e.confidence IS NOT NULL),
directed AS (SELECT * FROM typed UNION ALL SELECT target_id, source_id, 'reverse:' || relation, confidence FROM typed),
sums AS (SELECT target_id, relation, sum(confidence) AS s FROM directed GROUP BY 1, 2),
active AS (SELECT target_id, greatest(count(CASE WHEN s > 0 THEN 1 END), 1) AS k FROM sums GROUP BY 1),
weighted AS (SELECT d.*, d.confidence / greatest(s.s, 1e-12) / a.k AS weight FROM directed d
  JOIN sums s USING (target_id, relation) JOIN active a USING (target_id))
"""


def _weighted(spark: SparkSession, root: str) -> DataFrame:
    kinds = table(spark, root, "nodes").select("node_id", "node_type").distinct()
    return g.normalized_weights(g.with_reverse(_edges(spark, root).where(F.col("confidence").isNotNull()), kinds))


@query(_DIRECTED + "SELECT target_id, relation, count(*) AS n, round(sum(weight), 6) AS weight FROM weighted GROUP BY 1, 2")
def edge_weight_norm(spark: SparkSession, root: str) -> DataFrame:
    """Normalised weights per node and relation: equal shares for its active relations."""
    return _weighted(spark, root).groupBy("target_id", "relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    f"""WITH a AS (SELECT source_id, target_id AS mid, confidence AS c1 FROM {_E} WHERE edge_type = 'paper_has_section'),
b AS (SELECT source_id AS mid, target_id, confidence AS c2 FROM {_E} WHERE edge_type LIKE 'section_mentions_%')
SELECT a.source_id, b.target_id, round(max(least(c1, c2)), 6) AS confidence, count(*) AS n FROM a JOIN b USING (mid)
WHERE a.source_id <> b.target_id GROUP BY 1, 2"""
)
def two_hop_edges(spark: SparkSession, root: str) -> DataFrame:
    """Papers and what their sections mention."""
    e = _edges(spark, root)
    return g.two_hop(e.where(F.col("edge_type") == "paper_has_section"), e.where(F.col("edge_type").startswith("section_mentions_")))


@query(
    _CROSS
    + """, anchors AS (SELECT source_id AS node, round(avg(confidence), 4) AS score FROM
  (SELECT DISTINCT edge_id, source_id, confidence FROM edges WHERE edge_type = 'paper_uses_method' AND source_id IS NOT NULL) x GROUP BY 1),
sym AS (SELECT source_id AS node, target_id AS dst, weight, confidence, shared_count FROM crossed
  UNION ALL SELECT target_id, source_id, weight, confidence, shared_count FROM crossed),
boosts AS (SELECT dst, least(4.0, weight * (1 + 0.08 * least(shared_count, 6)) * confidence * score * 0.72) AS boost FROM sym JOIN anchors USING (node))
SELECT dst AS node, round(sum(boost), 5) AS boost, count(*) AS n_anchors FROM boosts WHERE boost >= 0.15 GROUP BY 1"""
)
def support_propagation(spark: SparkSession, root: str) -> DataFrame:
    """Support of papers handed on over cross-paper edges."""
    uses = _edges(spark, root).where((F.col("edge_type") == "paper_uses_method") & F.col("source_id").isNotNull())
    anchors = uses.groupBy(F.col("source_id").alias("node")).agg(F.round(F.avg("confidence"), 4).alias("score"))
    return g.propagate(anchors, _cross(spark, root))


@query(
    f"""SELECT e.edge_id, 'target_id' AS side, e.target_id AS ref FROM {_E} WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT node_id FROM nodes WHERE node_id IS NOT NULL)
UNION ALL SELECT e.edge_id, 'source_id', e.source_id FROM {_E} WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT node_id FROM nodes WHERE node_id IS NOT NULL)"""
)
def dangling_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges that end in no node."""
    nodes = table(spark, root, "nodes").select("node_id")
    parts = [
        g.dangling(_edges(spark, root).where(F.col(s).isNotNull()).select("edge_id", s), nodes, s).select("edge_id", F.lit(s).alias("side"), F.col(s).alias("ref"))
        for s in ("target_id", "source_id")
    ]
    return parts[0].unionByName(parts[1])


@query(
    """WITH s AS (SELECT DISTINCT node_id, paper_id, node_order FROM nodes WHERE node_type = 'section')
SELECT paper_id, node_id AS source, nxt AS target FROM (SELECT *, lead(node_id) OVER (PARTITION BY paper_id ORDER BY node_order, node_id) AS nxt FROM s) x WHERE nxt IS NOT NULL"""
)
def section_next(spark: SparkSession, root: str) -> DataFrame:
    """Each section and the next one of its paper."""
    return g.neighbours(_nodes(spark, root, "section", "paper_id", "node_order"), "paper_id", "node_order", "node_id")


@query(
    """WITH f AS (SELECT DISTINCT node_id, paper_id, page_start, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(
    regexp_extract(array_to_string(caption, ' '), '^\\s*((?:figure|fig\\.?|table|tab\\.?|chart)\\s*\\.?\\s*\\d+[A-Za-z]?)\\b', 1, 'i')), '.', ' '), '\\s+', ' ', 'g')), '^(fig|chart) ', 'figure '), '^tab ', 'table '), '^$', '') AS label
  FROM nodes WHERE node_type = 'figure' AND caption IS NOT NULL),
s AS (SELECT DISTINCT node_id, paper_id, page_start, node_order, lower(section_text) AS txt FROM nodes WHERE node_type = 'section' AND section_text IS NOT NULL),
hits AS (SELECT f.node_id AS figure_id, s.node_id AS section_id, abs(s.page_start - f.page_start) AS gap, s.node_order
  FROM f JOIN s ON f.paper_id = s.paper_id AND f.label <> '' AND regexp_matches(s.txt, '(^|[^a-z0-9])' || f.label || '($|[^a-z0-9])')
  WHERE abs(s.page_start - f.page_start) <= 1)
SELECT figure_id, section_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY gap, node_order, section_id) AS k FROM hits) x WHERE k = 1"""
)
def nearest_mention(spark: SparkSession, root: str) -> DataFrame:
    """The section nearest to a figure, within a page, that mentions its label."""
    figures = _nodes(spark, root, "figure", "paper_id", "page_start", "caption").where(F.col("caption").isNotNull())
    figures = figures.select(F.col("node_id").alias("figure_id"), "paper_id", F.col("page_start").alias("page"), tx.reference_label(F.array_join("caption", " ")).alias("label")).where(F.col("label") != "").distinct()
    sections = _nodes(spark, root, "section", "paper_id", "page_start", "node_order", "section_text").where(F.col("section_text").isNotNull())
    gap = F.abs(F.col("page_start") - F.col("page"))
    hit = F.regexp_like(F.lower("section_text"), F.concat(F.lit("(^|[^a-z0-9])"), F.col("label"), F.lit("($|[^a-z0-9])")))
    hits = figures.join(sections, "paper_id").where((gap <= 1) & hit).select("figure_id", F.col("node_id").alias("section_id"), gap.alias("gap"), "node_order")
    best = F.min(F.struct("gap", "node_order", "section_id")).alias("b")
    return hits.groupBy("figure_id").agg(best).select("figure_id", "b.section_id", "b.gap")


@query(
    """WITH a AS (SELECT DISTINCT paper_id, unnest(authors) AS name, generate_subscripts(authors, 1) AS pos FROM papers),
k AS (SELECT paper_id, pos, name, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM a WHERE name IS NOT NULL)
SELECT key, arg_min(name, paper_id || lpad(CAST(pos AS VARCHAR), 4, '0')) AS canonical_name, count(DISTINCT name) AS n_aliases, count(DISTINCT paper_id) AS n_papers
FROM k WHERE key <> '' GROUP BY 1"""
)
def author_entities(spark: SparkSession, root: str) -> DataFrame:
    """Authors by key: first spelling seen, aliases and papers."""
    rows = table(spark, root, "papers").select("paper_id", F.posexplode("authors").alias("i", "name")).distinct().where(F.col("name").isNotNull())
    rows = rows.withColumn("key", tx.entity_key("name")).where(F.col("key") != "")
    first = F.min_by("name", F.concat("paper_id", F.lpad((F.col("i") + 1).cast("string"), 4, "0")))
    return rows.groupBy("key").agg(first.alias("canonical_name"), F.countDistinct("name").alias("n_aliases"), F.countDistinct("paper_id").alias("n_papers"))


_RANKS = """WITH r AS (SELECT DISTINCT query_id, node_id, rank_score, section_direct_score FROM retrieval_scores),
a AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, node_id) AS pl FROM r WHERE rank_score IS NOT NULL AND NOT isnan(rank_score)),
b AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY section_direct_score DESC, node_id) AS pr FROM r WHERE section_direct_score IS NOT NULL AND NOT isnan(section_direct_score)),
la AS (SELECT * FROM a WHERE pl <= 20), lb AS (SELECT * FROM b WHERE pr <= 20),
f AS (SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(la.node_id, lb.node_id) AS node_id, pl, pr,
  round(coalesce((1 - 0.3) * 61 / (60 + pl), 0) + coalesce(0.3 * 61 / (60 + pr), 0), 4) AS score
  FROM la FULL JOIN lb ON la.query_id = lb.query_id AND la.node_id = lb.node_id)
SELECT query_id, node_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pl NULLS LAST, pr NULLS LAST, node_id) AS place FROM f) x WHERE place <= 10"""


@query(_RANKS)
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Two rankings of a query's sections fused by reciprocal ranks."""
    rows = table(spark, root, "retrieval_scores").select("query_id", "node_id", "rank_score", "section_direct_score").distinct()
    ranked = [
        rk.top_k(rows.where(F.col(c).isNotNull() & ~F.isnan(c)), ["query_id"], [F.desc(c), F.col("node_id")], 20) for c in ("rank_score", "section_direct_score")
    ]
    return rk.fuse(*ranked, group="query_id", key="node_id", weight=0.3, k=10)


_SCORES = "(SELECT DISTINCT query_id, paper_id, node_id, section_direct_score AS s FROM retrieval_scores WHERE section_direct_score IS NOT NULL AND NOT isnan(section_direct_score)) r"


def _section_scores(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "retrieval_scores").select("query_id", "paper_id", "node_id", F.col("section_direct_score").alias("s")).distinct()
    return rows.where(F.col("s").isNotNull() & ~F.isnan("s"))


@query(
    f"""SELECT query_id, round(sum(s * CASE place WHEN 1 THEN 1.0 WHEN 2 THEN 0.72 WHEN 3 THEN 0.55 ELSE 0.38 END), 6) AS total, count(*) AS used
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS place FROM {_SCORES}) x WHERE place <= 4 GROUP BY 1"""
)
def weighted_topk(spark: SparkSession, root: str) -> DataFrame:
    """Best four scores of a query, each counting less than the one before."""
    return rk.weighted_top_sum(_section_scores(spark, root), ["query_id"], "s", "node_id", [1.0, 0.72, 0.55, 0.38])


@query(
    f"""SELECT query_id, round(max(s) + 0.35 * coalesce(avg(CASE WHEN place > 1 THEN s END), 0), 6) AS total
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS place FROM {_SCORES}) x WHERE place <= 3 GROUP BY 1"""
)
def best_plus_tail(spark: SparkSession, root: str) -> DataFrame:
    """Best score of a query plus a share of the next two."""
    return rk.best_plus_tail(_section_scores(spark, root), ["query_id"], "s", "node_id")


@query(
    f"""WITH s AS (SELECT e.source_id AS paper, e.target_id AS entity, split_part(e.target_id, ':', 1) AS kind, e.confidence > 0.95 AS exact, e.edge_type AS section
  FROM {_E} WHERE e.edge_type LIKE 'paper_uses_%' AND e.source_id IS NOT NULL AND e.target_id IS NOT NULL),
c AS (SELECT paper, count(DISTINCT entity) AS e, count(DISTINCT kind) AS t, count(DISTINCT CASE WHEN exact THEN entity END) AS x, count(DISTINCT section) AS s FROM s GROUP BY 1)
SELECT paper, round(0.65::DOUBLE * e + 0.85 * t + 1.1 * greatest(e - 1, 0) + 1.4 * x + 2.2 * greatest(x - 1, 0) + 0.25 * s, 4) AS bonus, e AS entities, t AS kinds, x AS exact, s AS sections FROM c"""
)
def coverage_bonus(spark: SparkSession, root: str) -> DataFrame:
    """Bonus of papers for the entities they cover."""
    e = _edges(spark, root).where(F.col("edge_type").startswith("paper_uses_") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    support = e.select(F.col("source_id").alias("paper"), F.col("target_id").alias("entity"), F.substring_index("target_id", ":", 1).alias("kind"), (F.col("confidence") > 0.95).alias("exact"), F.col("edge_type").alias("section"))
    return rk.coverage_bonus(support, ["paper"])


@query(
    """SELECT query, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM (
SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 5) AS score
FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON q.vec_id <> v.vec_id) y) x WHERE place <= 10"""
)
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector among all vectors."""
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), "embedding")
    return rk.cosine_ranking(vectors, asked, key="vec_id", vector="embedding", k=10)


_RECALL_EDGES = f"(SELECT source_id AS paper, split_part(target_id, ':', 1) AS kind, confidence AS score FROM {_E} WHERE edge_type LIKE 'paper_uses_%' AND confidence IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL) s"


@query(
    f"""WITH best AS (SELECT 'all' AS query, kind, paper, max(score) AS score FROM {_RECALL_EDGES} WHERE score > 0 AND kind IN ('method', 'dataset', 'model', 'metric') GROUP BY 2, 3),
ranked AS (SELECT *, rank() OVER (PARTITION BY query, kind ORDER BY score DESC) AS rnk FROM best)
SELECT query, paper, round(sum(CASE kind WHEN 'method' THEN 1.0 WHEN 'dataset' THEN 0.75 ELSE 0.5 END / (60 + rnk)), 8) AS total, count(*) AS channels FROM ranked WHERE rnk <= 50 GROUP BY 1, 2"""
)
def channel_recall(spark: SparkSession, root: str) -> DataFrame:
    """Papers by their ranks among the channels of entity kinds, ties sharing a rank."""
    e = _edges(spark, root).where(F.col("edge_type").startswith("paper_uses_") & F.col("confidence").isNotNull() & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    scores = e.select(F.lit("all").alias("query"), F.substring_index("target_id", ":", 1).alias("kind"), F.col("source_id").alias("paper"), F.col("confidence").alias("score"))
    return rk.competition_recall(scores, weights={"method": 1.0, "dataset": 0.75, "model": 0.5, "metric": 0.5}, limit=50)


@query(
    """WITH s AS (SELECT DISTINCT node_id, paper_id, node_order, CAST(ceil(len(regexp_extract_all(section_text, '[一-鿿]|[A-Za-z0-9_]+|[^\\s]')) * 0.9) AS BIGINT) AS tokens FROM nodes WHERE node_type = 'section' AND section_text IS NOT NULL)
SELECT paper_id, node_id, tokens, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(tokens) OVER (PARTITION BY paper_id ORDER BY node_order, node_id ROWS UNBOUNDED PRECEDING) AS running FROM s) x WHERE running <= 800"""
)
def context_budget(spark: SparkSession, root: str) -> DataFrame:
    """Sections of a paper taken in order while 800 estimated tokens last."""
    s = _nodes(spark, root, "section", "paper_id", "node_order", "section_text").where(F.col("section_text").isNotNull())
    s = s.select("node_id", "paper_id", "node_order", tx.token_estimate("section_text").alias("tokens")).distinct()
    return rk.within_budget(s, "paper_id", ["node_order", "node_id"], "tokens", 800).select("paper_id", "node_id", "tokens", "running")


@query(
    """WITH p AS (SELECT DISTINCT paper_id, title FROM papers WHERE title IS NOT NULL), n AS (SELECT paper_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t FROM p),
src AS (SELECT paper_id, t AS s FROM n WHERE t <> '' UNION ALL SELECT paper_id, replace(t, ' ', '') FROM n WHERE t <> ''),
grams AS (SELECT paper_id, substr(s, CAST(i AS INT), k) AS gram FROM (SELECT paper_id, s, k, unnest(range(1, length(s) - k + 2)) AS i FROM src, (VALUES (2), (3), (4), (5)) v(k)) x UNION ALL SELECT paper_id, s FROM src WHERE length(s) = 1)
SELECT paper_id AS key, gram, count(*) AS n FROM grams GROUP BY 1, 2"""
)
def char_ngram_counts(spark: SparkSession, root: str) -> DataFrame:
    """Character n-grams of every title."""
    titles = table(spark, root, "papers").where(F.col("title").isNotNull()).select("paper_id", "title").distinct()
    return ngram_counts(titles, "paper_id", "title")


_GRAMS = """, {0}_src AS (SELECT key, t AS s FROM {0} WHERE t <> '' UNION ALL SELECT key, replace(t, ' ', '') FROM {0} WHERE t <> ''),
{0}_grams AS (SELECT key, gram, count(*) AS n FROM (
  SELECT key, substr(s, CAST(i AS INT), k) AS gram FROM (SELECT key, s, k, unnest(range(1, length(s) - k + 2)) AS i FROM {0}_src, (VALUES (2), (3), (4), (5)) v(k)) x
  UNION ALL SELECT key, s FROM {0}_src WHERE length(s) = 1) y GROUP BY 1, 2)"""
_TFIDF = (
    """WITH docs AS (SELECT DISTINCT paper_id AS key, trim(regexp_replace(lower(concat_ws(' ', title, abstract)), '\\s+', ' ', 'g')) AS t FROM papers WHERE paper_id IS NOT NULL),
asked AS (SELECT DISTINCT query_id AS key, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS t FROM query_cases WHERE query IS NOT NULL)"""
    + _GRAMS.format("docs")
    + _GRAMS.format("asked")
    + """, total AS (SELECT count(DISTINCT key) + 1.0::DOUBLE AS n FROM docs),
df AS (SELECT gram, count(*) AS df FROM docs_grams GROUP BY 1),
norms AS (SELECT key, sum((d.n * (ln((1 + t.n) / (1 + df)) + 1)) ** 2) AS norm0 FROM docs_grams d JOIN df USING (gram), total t GROUP BY 1),
w AS (SELECT a.key AS query, a.gram, a.n AS c, ln((1 + t.n) / (2 + coalesce(df, 0))) + 1 AS i, ln((1 + t.n) / (1 + coalesce(df, 0))) + 1 AS i0 FROM asked_grams a LEFT JOIN df USING (gram), total t),
qn AS (SELECT query, sum((c * i) ** 2) AS qnorm FROM w GROUP BY 1),
dots AS (SELECT query, key, sum(n * c * i * i) AS dot, sum(n * n * (i * i - i0 * i0)) AS delta FROM docs_grams JOIN w USING (gram) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM (
  SELECT query, key, round(dot / sqrt((norm0 + delta) * qnorm), 6) AS score FROM dots JOIN norms USING (key) JOIN qn USING (query)) x)
"""
)


@query(_TFIDF + "SELECT * FROM ranked WHERE place <= 10")
def tfidf_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten papers nearest to each query by n-gram TF-IDF of title and abstract."""
    papers = table(spark, root, "papers").select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    return rank_documents(papers, table(spark, root, "query_cases"), key="paper_id", text="text", query_key="query_id", query_text="query", k=10)


_BEST = """b AS (SELECT query_id, paper_id, max(section_direct_score) AS s FROM retrieval_scores WHERE section_direct_score IS NOT NULL AND NOT isnan(section_direct_score) GROUP BY 1, 2),
lb AS (SELECT * FROM (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, paper_id) AS pr FROM b) x WHERE pr <= 20),
la AS (SELECT query AS query_id, key AS paper_id, place AS pl FROM ranked WHERE place <= 10),
f AS (SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(la.paper_id, lb.paper_id) AS paper_id, pl, pr,
  round(coalesce((1 - 0.3) * 61 / (60 + pl), 0) + coalesce(0.3 * 61 / (60 + pr), 0), 4) AS score
  FROM la FULL JOIN lb ON la.query_id = lb.query_id AND la.paper_id = lb.paper_id)
SELECT query_id, paper_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pl NULLS LAST, pr NULLS LAST, paper_id) AS place FROM f) x WHERE place <= 10"""


@query(_TFIDF + ", " + _BEST)
def flagship(spark: SparkSession, root: str) -> DataFrame:
    """TF-IDF ranking of papers fused with the retrieval scores of their sections."""
    lexical = tfidf_topk(spark, root).select(F.col("query").alias("query_id"), F.col("key").alias("paper_id"), "place")
    best = _section_scores(spark, root).groupBy("query_id", "paper_id").agg(F.max("s").alias("s"))
    vector = rk.top_k(best, ["query_id"], [F.desc("s"), F.col("paper_id")], 20)
    return rk.fuse(lexical, vector, group="query_id", key="paper_id", weight=0.3, k=10)


@query(
    """SELECT DISTINCT paper_id, array_to_string(list_filter(list_transform(regexp_extract_all(title, '([A-Za-z]+(?:[-''][A-Za-z0-9]+)*|\\d+(?:\\.\\d+)?)', 1), lambda x: lower(x)),
lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\\d+$') AND w NOT IN ('and','are','for','from','that','the','this','was','were','with'))[1:12], '-') AS title_key
FROM papers WHERE title IS NOT NULL"""
)
def title_keys(spark: SparkSession, root: str) -> DataFrame:
    """Match keys of titles."""
    return table(spark, root, "papers").where(F.col("title").isNotNull()).select("paper_id", tx.title_key("title").alias("title_key")).distinct()


@query(r"SELECT DISTINCT doc_id, CAST(ceil(len(regexp_extract_all(text, '[一-鿿]|[A-Za-z0-9_]+|[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) * 0.9) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of every document."""
    rows = table(spark, root, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", tx.token_estimate("text", tx.ANY_ESTIMATE_UNIT).alias("tokens")).distinct()


@query(
    """SELECT DISTINCT node_id, CASE WHEN lower(section_title) LIKE '%abstract%' THEN 'abstract' WHEN regexp_matches(lower(section_title), 'introduction|background') THEN 'introduction'
WHEN regexp_matches(lower(section_title), 'method|materials|patients|cohort|study design') THEN 'methods' WHEN regexp_matches(lower(section_title), 'result|finding') THEN 'results'
WHEN lower(section_title) LIKE '%discussion%' THEN 'discussion' WHEN regexp_matches(lower(section_title), 'conclusion|summary|final remarks') THEN 'conclusion' ELSE 'other' END AS grp
FROM nodes WHERE node_type = 'section' AND section_title IS NOT NULL"""
)
def section_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups of sections by their titles."""
    return _nodes(spark, root, "section", "section_title").where(F.col("section_title").isNotNull()).select("node_id", tx.section_group("section_title").alias("grp")).distinct()


@query(
    """SELECT DISTINCT block_id, (text IS NULL OR length(trim(text, ' \t\n\r')) <= 1 OR regexp_matches(lower(trim(text)), '^\\s*https?://|\\bdoi\\.org\\b|^\\s*(citation|editor|copyright|academic editor|received|revised|accepted|published|funding|competing interests|correspondence)\\s*:|^\\s*(\\* )?e-?mail\\s*:')) AS low
FROM paper_content_list"""
)
def low_signal_filter(spark: SparkSession, root: str) -> DataFrame:
    """Blocks that carry no content."""
    return table(spark, root, "paper_content_list").select("block_id", tx.is_low_signal("text").alias("low")).distinct()


@query(
    """WITH a AS (SELECT DISTINCT node_id, canonical_name AS t FROM nodes WHERE node_type IN ('method', 'dataset', 'model', 'metric', 'task', 'venue')),
f AS (SELECT node_id, unnest([t, replace(t, '-', ' '), regexp_replace(t, '[–—]', ' ', 'g'), replace(t, '/', ' '), replace(t, '&', ' and '), regexp_replace(t, '[-–—/&]+', ' ', 'g')]) AS v FROM a),
l AS (SELECT node_id, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) AS v FROM f)
SELECT DISTINCT node_id, v AS variant FROM (SELECT * FROM l UNION ALL SELECT node_id, regexp_replace(v, '[^a-z0-9一-鿿]+', '', 'g') FROM l) x WHERE v <> ''"""
)
def lookup_variants(spark: SparkSession, root: str) -> DataFrame:
    """Forms under which a shared entity may be asked for."""
    n = table(spark, root, "nodes").where(F.col("node_type").isin("method", "dataset", "model", "metric", "task", "venue")).select("node_id", "canonical_name").distinct()
    return n.select("node_id", F.explode(tx.lookup_variants("canonical_name")).alias("variant")).distinct()


@query(
    """SELECT DISTINCT block_id, count(*) OVER (PARTITION BY block_id) AS n_paragraphs FROM (SELECT DISTINCT block_id, p FROM (
SELECT block_id, unnest(regexp_split_to_array(replace(text, chr(13), ''), '\\n\\s*\\n+')) AS p FROM (SELECT DISTINCT block_id, text FROM paper_content_list WHERE text IS NOT NULL)) y WHERE trim(p, ' \t\n') <> '') x"""
)
def paragraph_counts(spark: SparkSession, root: str) -> DataFrame:
    """Distinct paragraphs of every block."""
    rows = table(spark, root, "paper_content_list").where(F.col("text").isNotNull()).select("block_id", "text").distinct()
    parts = rows.select("block_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), r"\n\s*\n+")).alias("p"))
    return parts.where(F.length(F.regexp_replace("p", r"^[ \t\n]+|[ \t\n]+$", "")) > 0).distinct().groupBy("block_id").agg(F.count("*").alias("n_paragraphs"))
