"""Queries over papers' contents: bibliographies, chunks, mentions, windows, intents, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import bibliography as bib
from foliograph.operators import evidence, metadata
from foliograph.operators import windows
from foliograph.operators.mentions import mentions
from foliograph.operators.structure import chunk_papers
from foliograph.sources.store import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: fixed values: words of a query that point to a type of entity, found as parts of words
TYPE_HINTS = {
    "author": ["authors", "author"], "institution": ["institution", "institutions", "affiliation"], "venue": ["venue", "journal", "conference"],
    "reference": ["reference", "citation", "cites", " citing ", " cited ", " bibliography", " works cited"], "method": ["method"], "dataset": ["dataset"],
    "task": ["task"], "metric": ["metric", "score"], "model": ["model"],
}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _references(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "nodes").where(F.col("node_type") == "reference")
    return rows.select("node_id", F.col("citation_title").alias("title"), F.col("citation_year").alias("year"), F.col("citation_author_text").alias("authors")).distinct()


def _bibliography(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "paper_content_list").where(F.col("sub_type").isin("reference", "ref_text"))
    return blocks.select("block_id", F.coalesce("text", F.array_join("list_items", "\n")).alias("text")).distinct()


_LABEL = "(?:\\[\\d+[A-Za-z]?\\]|\\d+[A-Za-z]?[.)])"


@query(
    f"""WITH t AS (SELECT DISTINCT block_id, regexp_replace(coalesce(text, array_to_string(list_items, chr(10))), '\r\n?', chr(10), 'g') AS t FROM paper_content_list WHERE sub_type IN ('reference', 'ref_text')),
li AS (SELECT block_id, t, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM t WHERE t IS NOT NULL),
st AS (SELECT block_id, t, n, l, sum(CASE WHEN regexp_matches(trim(l, ' ' || chr(9)), '^{_LABEL}(?:\\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, t ORDER BY n) AS e FROM li),
en AS (SELECT block_id, t, e, trim(regexp_replace(string_agg(l, ' ' ORDER BY n), '\\s+', ' ', 'g')) AS raw FROM st GROUP BY 1, 2, 3),
nu AS (SELECT block_id, row_number() OVER (PARTITION BY block_id, t ORDER BY e) AS entry_no, raw FROM en WHERE raw <> '')
SELECT DISTINCT block_id, CAST(entry_no AS INT) AS entry_no, regexp_extract(regexp_extract(raw, '^(?:\\[\\d+[A-Za-z]?\\]|\\d+[A-Za-z]?[.)]\\s)'), '(\\d+[A-Za-z]?)', 1) AS label,
regexp_extract(trim(regexp_replace(raw, '^{_LABEL}\\s*', '')), '\\b((?:19|20)\\d{{2}})\\b', 1) AS year FROM nu"""
)
def reference_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels and years of every entry of every bibliography block."""
    got = bib.entries(_bibliography(spark, root), "block_id", "text")
    return got.select("block_id", "entry_no", "label", F.regexp_extract("entry", r"\b((?:19|20)\d{2})\b", 1).alias("year")).distinct()


@query()
def parsed_citations(spark: SparkSession, root: str) -> DataFrame:
    """Fields of every bibliography entry that is a citation."""
    return bib.parse(bib.entries(_bibliography(spark, root), "block_id", "text").where(bib.is_citation(F.col("entry"))), "entry")


@query()
def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every paper under their section paths."""
    return chunk_papers(table(spark, root, "paper_content_list"))


@query()
def section_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Shared entities mentioned in section texts."""
    nodes = table(spark, root, "nodes")
    names = nodes.where(F.col("node_type").isin("method", "dataset", "task", "metric", "model")).select(F.col("node_id").alias("entity"), F.col("canonical_name").alias("name"))
    return mentions(nodes.where(F.col("node_type") == "section").select("node_id", "section_text"), names, key="node_id", text="section_text")


@query(
    """WITH s AS (SELECT 0.2 + 0.1 * i AS s FROM range(0, 7) r(i)), a AS (SELECT i / 8.0 AS v FROM range(0, 9) r(i))
SELECT DISTINCT round((1 - s)::DOUBLE * ax.v, 6) AS x0, round((1 - s)::DOUBLE * ay.v, 6) AS y0, round(round((1 - s)::DOUBLE * ax.v, 6) + s, 6) AS x1, round(round((1 - s)::DOUBLE * ay.v, 6) + s, 6) AS y1, round((s * s)::DOUBLE, 6) AS area
FROM s, a ax, a ay"""
)
def window_grid(spark: SparkSession, root: str) -> DataFrame:
    """Candidate windows of seven scales."""
    return windows.grid(spark, [round(0.2 + 0.1 * i, 1) for i in range(7)])


@query(
    """WITH b AS (SELECT DISTINCT block_id, page_idx, paper_id, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM paper_content_list WHERE len(bbox) = 4 AND img_path IS NOT NULL AND page_idx IS NOT NULL),
p AS (SELECT a.block_id AS a_id, b.block_id AS b_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS shared,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS total FROM b a JOIN b b ON a.paper_id = b.paper_id AND a.page_idx = b.page_idx AND a.block_id < b.block_id)
SELECT a_id, b_id, round(CASE WHEN total - shared > 0 THEN shared / (total - shared) ELSE 0 END, 6) AS iou FROM p"""
)
def iou_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Overlap of the images of one page."""
    box = F.struct(*[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    rows = table(spark, root, "paper_content_list").where((F.size("bbox") == 4) & F.col("img_path").isNotNull() & F.col("page_idx").isNotNull())
    rows = rows.select("paper_id", "page_idx", "block_id", box.alias("box")).distinct()
    other = rows.select("paper_id", "page_idx", F.col("block_id").alias("b_id"), F.col("box").alias("other"))
    pairs = rows.join(other, ["paper_id", "page_idx"]).where(F.col("block_id") < F.col("b_id"))
    return pairs.select(F.col("block_id").alias("a_id"), "b_id", F.round(windows.iou("box", "other"), 6).alias("iou"))


_HINTS = " || ".join(f"CASE WHEN {' OR '.join(f'contains(lower(query), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind},' ELSE '' END" for kind, words in TYPE_HINTS.items())


@query(
    f"""SELECT DISTINCT query_id, {_HINTS} AS kinds, regexp_matches(query, '\\b(which|what)\\s+papers\\b|\\blist\\s+(all\\s+)?(the\\s+)?papers\\b', 'i') AS exhaustive,
regexp_matches(lower(query), '\\b(find|show|locate|look up|lookup)\\b') AS wants FROM query_cases WHERE query IS NOT NULL"""
)
def query_intents(spark: SparkSession, root: str) -> DataFrame:
    """What kinds of entities a query names and whether it asks for a list or a search."""
    low = F.lower("query")
    kinds = [F.when(F.array_contains(F.array(*[low.contains(w) for w in words]), True), f"{kind},").otherwise("") for kind, words in TYPE_HINTS.items()]
    exhaustive = F.col("query").rlike(r"(?i)\b(?:which|what)\s+papers\b|\blist\s+(?:all\s+)?(?:the\s+)?papers\b")
    rows = table(spark, root, "query_cases").where(F.col("query").isNotNull())
    return rows.select("query_id", F.concat(*kinds).alias("kinds"), exhaustive.alias("exhaustive"), low.rlike(r"\b(?:find|show|locate|look up|lookup)\b").alias("wants")).distinct()


@query(
    """SELECT 'node rows repeated' AS rule, count(*) AS n FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1) x
UNION ALL SELECT 'edge rows repeated', count(*) FROM (SELECT edge_id FROM edges GROUP BY 1 HAVING count(*) > 1) x
UNION ALL SELECT 'confidence missing', count(DISTINCT edge_id) FROM edges WHERE confidence IS NULL
UNION ALL SELECT 'confidence out of range', count(DISTINCT edge_id) FROM edges WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'reference empty', count(DISTINCT edge_id) FROM edges WHERE coalesce(source_id, '') = '' OR coalesce(target_id, '') = ''"""
)
def graph_audit(spark: SparkSession, root: str) -> DataFrame:
    """How many records break each rule of the graph."""
    nodes, edges = table(spark, root, "nodes").select("node_id"), table(spark, root, "edges").select("edge_id", "source_id", "target_id", "confidence")
    repeated = lambda df, key, rule: df.groupBy(key).count().where(F.col("count") > 1).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    rules = {
        "confidence missing": F.col("confidence").isNull(),
        "confidence out of range": (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "reference empty": (F.coalesce("source_id", F.lit("")) == "") | (F.coalesce("target_id", F.lit("")) == ""),
    }
    out = repeated(nodes, "node_id", "node rows repeated").unionByName(repeated(edges, "edge_id", "edge rows repeated"))
    for rule, broken in rules.items():
        out = out.unionByName(edges.where(broken).agg(F.countDistinct("edge_id").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return out


@query(
    """WITH words AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z]{5,}')) AS w FROM query_cases WHERE query IS NOT NULL),
asked AS (SELECT query_id, count(DISTINCT w) AS n FROM words GROUP BY 1),
texts AS (SELECT DISTINCT q.query_id, e.node_id, lower(n.section_text) AS t FROM (SELECT query_id, unnest(expected_nodes) AS node_id FROM query_cases) e JOIN query_cases q USING (query_id) JOIN nodes n USING (node_id) WHERE n.section_text IS NOT NULL)
SELECT t.query_id, t.node_id, count(DISTINCT w.w) AS found, max(a.n) AS asked FROM texts t JOIN asked a USING (query_id)
JOIN words w ON w.query_id = t.query_id AND regexp_matches(t.t, '\\b' || w.w || '\\b') GROUP BY 1, 2"""
)
def evidence_audit(spark: SparkSession, root: str) -> DataFrame:
    """How many words of a query stand, as whole words, in the sections expected for it."""
    cases = table(spark, root, "query_cases").where(F.col("query").isNotNull()).select("query_id", "query", "expected_nodes").distinct()
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z]{5,})"), 1))
    asked = cases.select("query_id", words.alias("words"), F.explode("expected_nodes").alias("node_id"))
    texts = table(spark, root, "nodes").where(F.col("section_text").isNotNull()).select("node_id", F.lower("section_text").alias("t")).distinct()
    hits = F.filter("words", lambda w: F.regexp_like(F.col("t"), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    return asked.join(texts, "node_id").select("query_id", "node_id", F.size(hits).cast("bigint").alias("found"), F.size("words").cast("bigint").alias("asked")).where(F.col("found") > 0).distinct()


@query(
    """WITH b AS (SELECT DISTINCT paper_id, item_index, text_level, trim(text) AS t FROM paper_content_list WHERE text IS NOT NULL AND length(trim(text)) > 0),
y AS (SELECT paper_id, arg_min(regexp_extract(t, '((?:19|20)\\d{2})', 1), item_index) AS year FROM b WHERE item_index < 40 AND regexp_matches(t, '(?:19|20)\\d{2}') GROUP BY 1),
ti AS (SELECT paper_id, arg_min(t, CASE WHEN text_level = 1 THEN 0 ELSE 100000 END + item_index) AS title FROM b WHERE text_level = 1 OR length(t) > 20 GROUP BY 1)
SELECT p.paper_id, regexp_replace(ti.title, '[ \t]+', ' ', 'g') AS title, y.year FROM (SELECT DISTINCT paper_id FROM b) p LEFT JOIN ti USING (paper_id) LEFT JOIN y USING (paper_id)"""
)
def front_matter(spark: SparkSession, root: str) -> DataFrame:
    """Titles and years read from the first blocks of papers."""
    blocks = table(spark, root, "paper_content_list").select("paper_id", "item_index", "text", "text_level").distinct()
    return metadata.front_matter(blocks).select("paper_id", "title", "year")


@query(
    """WITH p AS (SELECT DISTINCT node_id AS node, paper_id AS paper FROM papers), e AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type IN ('paper_has_section', 'section_has_figure')),
l1 AS (SELECT DISTINCT e.target_id AS node, p.paper FROM p JOIN e ON e.source_id = p.node WHERE e.target_id IS NOT NULL),
l2 AS (SELECT DISTINCT e.target_id AS node, l1.paper FROM l1 JOIN e ON e.source_id = l1.node WHERE e.target_id IS NOT NULL)
SELECT node, min(paper) AS paper, count(*) AS n_papers FROM (SELECT * FROM p UNION SELECT * FROM l1 UNION SELECT * FROM l2) x GROUP BY 1"""
)
def node_owners(spark: SparkSession, root: str) -> DataFrame:
    """The paper that owns each section and figure."""
    e = table(spark, root, "edges").where(F.col("edge_type").isin("paper_has_section", "section_has_figure") & F.col("target_id").isNotNull())
    papers = table(spark, root, "papers").select("node_id", F.col("paper_id").alias("paper")).distinct()
    return evidence.owners(e.select("source_id", "target_id").distinct(), papers)
