"""Queries over wordings: what is asked for, what that is worth to papers and sections, modes of retrieval, and the context made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import bundle, evidence, metadata
from foliograph.operators import query_rules as qr
from foliograph.operators import ranking as rk
from foliograph.operators.graph import all_constraints
from foliograph.operators.paper_rank import finish, phase_one, rank_papers
from foliograph.operators.tfidf import score_documents
from foliograph.plans.citation_queries import cross_edges
from foliograph.plans.paper_queries import TYPE_HINTS
from foliograph.plans.registry import registry
from foliograph.sources.store import settle, table

QUERIES, ORACLE_SQL, query = registry()
EVERY = 20

_ASKED = f"""WITH asked AS (SELECT DISTINCT query_id AS query, query AS wording FROM query_cases WHERE query IS NOT NULL
  UNION SELECT 'title:' || paper_id, 'Explain the paper titled "' || title || '"' FROM papers WHERE title IS NOT NULL AND TRY_CAST(substr(paper_id, 2) AS BIGINT) % {EVERY} = 0
  UNION SELECT node_id, section_text FROM nodes WHERE node_type = 'section' AND length(section_text) > 0 AND TRY_CAST(substr(paper_id, 2) AS BIGINT) % {EVERY} = 0)
"""


def asked_texts(spark: SparkSession, root: str) -> DataFrame:
    """(query, wording): the given queries, a question about each twentieth paper by its title, and the texts of its sections."""
    cases = table(spark, root, "query_cases").where(F.col("query").isNotNull()).select(F.col("query_id").alias("query"), F.col("query").alias("wording"))
    papers = table(spark, root, "papers").where(F.expr(f"try_cast(substring(paper_id, 2) AS BIGINT) % {EVERY} = 0"))
    titles = papers.where(F.col("title").isNotNull()).select(F.concat(F.lit("title:"), "paper_id"), F.concat(F.lit('Explain the paper titled "'), "title", F.lit('"')))
    sections = table(spark, root, "nodes").where((F.col("node_type") == "section") & (F.length("section_text") > 0) & F.expr(f"try_cast(substring(paper_id, 2) AS BIGINT) % {EVERY} = 0"))
    return cases.union(titles).union(sections.select("node_id", "section_text")).distinct()


def _look(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _compact(c: str) -> str:
    return f"regexp_replace({_look(c)}, '[^a-z0-9一-鿿]+', '', 'g')"


_HINTED = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(wording), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}' END" for kind, words in TYPE_HINTS.items())
_NAMES = """, names AS (SELECT DISTINCT node_id AS entity, node_type AS kind, trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS name FROM nodes WHERE node_type IN ('method', 'dataset', 'task', 'metric', 'model') AND canonical_name IS NOT NULL)"""
_MATCHES = (
    _ASKED
    + _NAMES
    + f""", hinted AS (SELECT query, wording, list_filter([{_HINTED}], lambda h: h IS NOT NULL) AS hints FROM asked),
toks AS (SELECT query, regexp_extract_all(wording, '{qr.TOKEN}') AS w FROM asked),
grams AS (SELECT DISTINCT query, {_look("array_to_string(w[i:i + n - 1], ' ')")} AS phrase FROM (SELECT query, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM toks, (SELECT unnest(range(1, (SELECT max(len(string_split(name, ' '))) + 1 FROM names))) AS n) k) x),
quoted AS (SELECT DISTINCT query, {_look('q')} AS phrase FROM (SELECT query, unnest(regexp_extract_all(wording, '["“”''‘’](.+?)["“”''‘’]', 1)) AS q FROM asked) x WHERE trim(q) <> ''),
found AS (SELECT query, phrase, 1.2 AS s FROM grams WHERE phrase <> '' UNION ALL SELECT query, phrase, 2.0 FROM quoted),
hit AS (SELECT f.query, n.entity, n.kind, max(s) AS s FROM found f JOIN names n ON n.name = f.phrase GROUP BY 1, 2, 3),
typed AS (SELECT hit.*, list_contains(h.hints, kind) AS wanted, max(list_contains(h.hints, kind)::INT) OVER (PARTITION BY hit.query) AS anyw FROM hit JOIN hinted h USING (query)),
matches AS (SELECT query, entity, kind, round((s + CASE WHEN wanted THEN 0.35 ELSE 0 END)::DOUBLE, 6) AS score FROM typed WHERE wanted OR anyw = 0)
"""
)


def _hints(c: str) -> F:
    low = F.lower(c)
    kinds = [F.when(low.rlike("|".join(words)), F.lit(kind)) for kind, words in TYPE_HINTS.items()]
    return F.filter(F.array(*kinds), lambda h: h.isNotNull())


def _names(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nodes").where(F.col("node_type").isin(qr.SEMANTIC) & F.col("canonical_name").isNotNull())
    return n.select(F.col("node_id").alias("entity"), F.col("node_type").alias("kind"), tx.lookup_text("canonical_name").alias("name")).distinct()


def entity_matches(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(query, entity, kind, score): entities whose whole names stand in a wording; quoted names count 2, others 1.2, a wanted type .35 more.

    Both sides are cut into word n-grams up to the longest name, so the match is an
    equi-join. If any match is of a type that the wording points to, the others go.
    """
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    grams = asked.select("query", F.explode(qr.word_ngrams(F.col("wording"), longest)).alias("name"), F.lit(1.2).alias("s"))
    quoted = asked.select("query", F.explode(F.transform(qr.quoted_spans(F.col("wording")), tx.lookup_text)).alias("name"), F.lit(2.0).alias("s"))
    hit = grams.unionByName(quoted).join(names, "name").groupBy("query", "entity", "kind").agg(F.max("s").alias("s"))
    typed = hit.join(asked.select("query", _hints("wording").alias("hints")), "query").withColumn("wanted", F.array_contains("hints", F.col("kind")))
    any_wanted = typed.where("wanted").select("query").distinct().withColumn("any", F.lit(True))
    kept = typed.join(any_wanted, "query", "left").where(F.col("wanted") | F.col("any").isNull())
    return kept.select("query", "entity", "kind", F.round(F.col("s") + F.when(F.col("wanted"), 0.35).otherwise(0.0), 6).alias("score"))


@query(_MATCHES + "SELECT query, entity AS node_id, kind AS node_type, score FROM matches")
def exact_entity_match(spark: SparkSession, root: str) -> DataFrame:
    """Entities whose whole name stands in what is asked."""
    return entity_matches(asked_texts(spark, root), _names(spark, root)).select("query", F.col("entity").alias("node_id"), F.col("kind").alias("node_type"), "score")


_VISUAL = f"(regexp_matches(wording, '(?i){qr.VISUAL}') OR regexp_matches(wording, '(?i){qr.SHOWN_GRAPH}'))"
_SET = lambda types: "[" + ", ".join(f"'{t}'" for t in types) + "]"


@query(
    _MATCHES
    + f""", ex AS (SELECT query, list(DISTINCT kind) AS exact FROM matches GROUP BY 1),
b AS (SELECT h.query, wording, hints, coalesce(exact, []) AS exact FROM hinted h LEFT JOIN ex USING (query)),
t AS (SELECT *, CASE WHEN len(list_intersect(hints, {_SET(qr.SEMANTIC)})) > 0 THEN list_intersect(hints, {_SET(qr.SEMANTIC)}) ELSE list_intersect(exact, {_SET(qr.SEMANTIC)}) END AS sem,
  CASE WHEN len(list_intersect(hints, {_SET(qr.STRUCTURED)})) > 0 THEN list_intersect(hints, {_SET(qr.STRUCTURED)}) ELSE list_intersect(exact, {_SET(qr.METADATA)}) END AS str FROM b),
r AS (SELECT *, len(list_intersect(str, {_SET(qr.METADATA)})) > 0 AS meta, list_contains(str, 'reference') OR (list_contains(exact, 'reference') AND len(sem) = 0 AND len(list_intersect(str, {_SET(qr.METADATA)})) = 0) AS ref FROM t),
s AS (SELECT *, len(sem) > 0 OR (regexp_matches(wording, '(?i){qr.EXPLAINS}') AND NOT meta AND NOT ref) AS semq FROM r)
SELECT query, CASE WHEN meta AND semq THEN 'mixed' WHEN semq THEN 'semantic' WHEN ref THEN 'reference' WHEN meta THEN 'metadata' ELSE 'default' END AS focus, ref AS reference_query, {_VISUAL} AS visual,
regexp_matches(trim(regexp_replace(wording, '\\s+', ' ', 'g')), '(?i){qr.LISTS}') AS list, regexp_matches(lower(wording), ' and | with | plus ') AS conjunction FROM s"""
)
def query_focus(spark: SparkSession, root: str) -> DataFrame:
    """What kind of sections each query wants, and whether it asks for pictures, lists or joint concepts."""
    asked = asked_texts(spark, root)
    exact = entity_matches(asked, _names(spark, root)).groupBy("query").agg(F.collect_set("kind").alias("exact"))
    d = qr.focus(asked.withColumn("hints", _hints("wording")).join(exact, "query", "left").withColumn("likely", F.array().cast("array<string>")))
    w = F.col("wording")
    return d.select("query", "focus", "reference_query", qr.is_visual(w).alias("visual"), qr.is_list(w).alias("list"), qr.has_conjunction(w).alias("conjunction"))


_CLEAN = lambda s: f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({s}, '\\s+', ' ', 'g')), '^[ ,.;:!?()\\[\\]{{}}]+|[ ,.;:!?()\\[\\]{{}}]+$', '', 'g')), '{qr.REQUEST}', ''))"
_TITLES = ", titles AS (SELECT DISTINCT node_id AS paper, {l} AS t, {c} AS tc, {pl} AS p, {pc} AS pc FROM papers WHERE length(trim(title)) > 0)".format(l=_look("title"), c=_compact("title"), pl=_look("split_part(title, ':', 1)"), pc=_compact("split_part(title, ':', 1)"))
_PHRASES = (
    _ASKED
    + _TITLES
    + f""", raw AS (SELECT query, wording, unnest(list_filter(regexp_extract_all(wording, '["“”''‘’](.+?)["“”''‘’]', 1), lambda s: trim(s) <> '')) AS s FROM asked WHERE contains(lower(wording), 'title')
  UNION ALL SELECT query, wording, regexp_extract(wording, '(?i)(?:paper|paper title|title)\\s*(?:is|=|:)?\\s*(.+?)\\s*(?:paper)?[?]?\\s*$', 1) FROM asked WHERE contains(lower(wording), 'title')
  UNION ALL SELECT query, wording, unnest(sp[greatest(len(sp) - 2, 1):]) FROM (SELECT query, wording, regexp_extract_all(regexp_split_to_array(wording, '(?i)(?:this\\s+paper|these\\s+papers?|the\\s+paper)')[1], '{qr.TITLE_SPAN.replace(chr(39), chr(39) * 2)}') AS sp FROM asked
    WHERE regexp_matches(wording, '(?i)(?:this\\s+paper|these\\s+papers?|the\\s+paper)') AND NOT regexp_matches(trim(regexp_replace(wording, '\\s+', ' ', 'g')), '(?i){qr.LISTS}')) x),
cl AS (SELECT DISTINCT query, {_CLEAN('s')} AS phrase FROM raw WHERE s <> ''),
phrases AS (SELECT * FROM cl WHERE length({_compact('phrase')}) >= 8 AND (len(regexp_extract_all(phrase, '{qr.TOKEN}')) >= 2 OR regexp_matches(phrase, '[:()-]'))),
targets AS (SELECT query, xc, min(x) AS x FROM (SELECT query, {_look('phrase')} AS x, {_compact('phrase')} AS xc FROM phrases) y WHERE xc <> '' GROUP BY 1, 2),
tb AS (SELECT query, paper, max(CASE WHEN p = x OR pc = xc THEN 168 WHEN t = x OR tc = xc THEN 120 ELSE 52 END) + 6.0::DOUBLE AS delta FROM targets, titles
  WHERE p = x OR pc = xc OR t = x OR tc = xc OR (length(xc) >= 10 AND (contains(t, x) OR contains(x, t) OR contains(tc, xc) OR contains(xc, tc))) GROUP BY 1, 2)
"""
)


def _papers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "papers").select(F.col("node_id").alias("paper"), "title").distinct()


def _phrased(spark: SparkSession, root: str) -> DataFrame:
    return asked_texts(spark, root).withColumn("phrases", qr.title_phrases(F.col("wording")))


@query(_PHRASES + "SELECT * FROM tb")
def title_boosts(spark: SparkSession, root: str) -> DataFrame:
    """What papers gain by titles that a query names."""
    return qr.title_bonus(_phrased(spark, root), _papers(spark, root))


_VARIANTS = "[h, replace(h, '-', ' '), regexp_replace(h, '[–—]', ' ', 'g'), replace(h, '/', ' '), replace(h, '&', ' and '), regexp_replace(h, '[-–—/&]+', ' ', 'g')]"
_FIGURES = """, figs AS (SELECT DISTINCT 'paper:' || paper_id AS paper, array_to_string(caption, ' ') AS text FROM nodes WHERE node_type = 'figure' AND len(caption) > 0)"""


def _figures(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "nodes").where((F.col("node_type") == "figure") & (F.size("caption") > 0))
    return f.select(F.concat(F.lit("paper:"), "paper_id").alias("paper"), F.array_join("caption", " ").alias("text")).distinct()


@query(
    _ASKED
    + _TITLES
    + _FIGURES
    + f""", hs AS (SELECT DISTINCT query, h FROM (SELECT query, unnest(regexp_extract_all(wording, '{qr.TOKEN}')) AS h FROM asked) x
  WHERE length({_compact('h')}) >= 4 AND (regexp_matches(substr(h, 2), '[A-Z]') OR (regexp_matches(h, '[A-Z]') AND upper(h) = h) OR (contains(h, '-') AND regexp_matches(h, '[A-Z]')))),
v0 AS (SELECT query, unnest({_VARIANTS}) AS v FROM hs), v1 AS (SELECT query, {_look('v')} AS x FROM v0 UNION SELECT query, {_compact('v')} FROM v0),
vs AS (SELECT DISTINCT query, x, {_compact('x')} AS xc FROM v1 WHERE x <> '' AND length({_compact('x')}) >= 4),
one AS (SELECT query, xc, any_value(x) AS x FROM vs GROUP BY 1, 2),
bt AS (SELECT query, paper, xc, p = x OR pc = xc AS first, CASE WHEN p = x OR pc = xc THEN 180 WHEN t = x OR tc = xc THEN 110 ELSE 96 END AS b FROM one, titles WHERE p = x OR pc = xc OR t = x OR tc = xc OR contains(t, x) OR contains(tc, xc)),
al AS (SELECT query, max(paper) AS paper, 340 AS b FROM bt WHERE first GROUP BY query, xc HAVING count(*) = 1),
fg AS (SELECT query, paper, 48 AS b FROM one, (SELECT paper, {_look('text')} AS t, {_compact('text')} AS tc FROM figs WHERE length(text) > 0) f WHERE contains(t, x) OR contains(tc, xc))
SELECT query, paper, max(b)::DOUBLE AS delta FROM (SELECT query, paper, b FROM bt UNION ALL SELECT * FROM al UNION ALL SELECT * FROM fg) u GROUP BY 1, 2"""
)
def handle_boosts(spark: SparkSession, root: str) -> DataFrame:
    """What papers gain by names of systems in a query that stand in their titles or figures."""
    asked = asked_texts(spark, root).withColumn("handles", qr.handles(F.col("wording")))
    return qr.handle_bonus(asked, _papers(spark, root), _figures(spark, root))


@query(
    _ASKED
    + f""", al AS (SELECT DISTINCT node_id AS paper, unnest([CASE WHEN length(trim(title)) >= 8 THEN lower(trim(title)) END, CASE WHEN contains(title, ':') AND length(trim(split_part(trim(title), ':', 1))) BETWEEN 3 AND 48
    AND len(regexp_split_to_array(trim(split_part(trim(title), ':', 1)), '\\s+')) <= 4 THEN lower(trim(split_part(trim(title), ':', 1))) END]) AS alias FROM papers WHERE title IS NOT NULL),
single AS (SELECT alias, max(paper) AS paper FROM (SELECT DISTINCT paper, alias FROM al WHERE alias IS NOT NULL) x GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT query, lower(wording) AS low FROM asked WHERE regexp_matches(wording, '(?i){qr.NAMES_SOURCE}') AND NOT regexp_matches(trim(regexp_replace(wording, '\\s+', ' ', 'g')), '(?i){qr.LISTS}') AND NOT regexp_matches(wording, '(?i){qr.CITES}'))
SELECT DISTINCT query, paper FROM q, single WHERE contains(low, alias) AND regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(alias) || '($|[^\\p{{L}}\\p{{N}}_])') AND regexp_matches(alias, '[\\p{{L}}\\p{{N}}_]')"""
)
def named_source_papers(spark: SparkSession, root: str) -> DataFrame:
    """Papers that an explaining query names."""
    return qr.named_sources(asked_texts(spark, root), _papers(spark, root))


_USES = "('paper_uses_method', 'paper_uses_dataset', 'paper_uses_model', 'paper_uses_metric', 'paper_addresses_task')"
_LINKS = f", links AS (SELECT DISTINCT source_id AS paper, target_id AS entity FROM edges WHERE edge_type IN {_USES} AND source_id IS NOT NULL AND target_id IS NOT NULL)"


def _links(spark: SparkSession, root: str) -> DataFrame:
    kinds = [k.strip("' ") for k in _USES.strip("()").split(",")]
    e = table(spark, root, "edges").where(F.col("edge_type").isin(kinds) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return e.select(F.col("source_id").alias("paper"), F.col("target_id").alias("entity")).distinct()


@query(
    _MATCHES
    + _LINKS
    + """, total AS (SELECT query, count(DISTINCT name) AS concepts FROM matches JOIN names USING (entity, kind) GROUP BY 1),
cov AS (SELECT m.query, l.paper, count(DISTINCT n.name) AS covered FROM matches m JOIN names n USING (entity, kind) JOIN links l USING (entity) GROUP BY 1, 2),
mx AS (SELECT query, max(covered) AS most FROM cov GROUP BY 1)
SELECT query, paper, covered, concepts, round((1.2 * covered + CASE WHEN covered >= 2 THEN 1.6 * (covered - 1) ELSE 0 END + CASE WHEN covered = concepts THEN 4.8 + 1.4 * concepts WHEN covered = most AND covered >= 2 THEN 2 ELSE 0 END)::DOUBLE, 6) AS delta
FROM cov JOIN total USING (query) JOIN mx USING (query)"""
)
def concept_boosts(spark: SparkSession, root: str) -> DataFrame:
    """What papers gain by covering the concepts of a query."""
    names = _names(spark, root)
    m = entity_matches(asked_texts(spark, root), names).join(names, ["entity", "kind"]).select("query", "entity", F.col("name").alias("concept"))
    return qr.concept_bonus(m, _links(spark, root))


_BY = f"""WITH own AS (SELECT DISTINCT e.source_id AS query, e.target_id AS entity, CASE e.edge_type WHEN 'paper_has_author' THEN 'author' ELSE 'institution' END AS kind FROM edges e JOIN papers p ON p.node_id = e.source_id
  WHERE e.edge_type IN ('paper_has_author', 'paper_has_institution') AND e.target_id IS NOT NULL AND TRY_CAST(substr(p.paper_id, 2) AS BIGINT) % {EVERY} = 0),
links AS (SELECT DISTINCT source_id AS paper, target_id AS entity FROM edges WHERE edge_type IN ('paper_has_author', 'paper_has_institution') AND source_id IS NOT NULL AND target_id IS NOT NULL)
"""


@query(
    _BY
    + """, pt AS (SELECT DISTINCT query, kind, paper FROM own JOIN links USING (entity)), need AS (SELECT query, count(DISTINCT kind) AS need FROM pt GROUP BY 1)
SELECT query, paper FROM (SELECT query, paper, count(*) AS have FROM pt GROUP BY 1, 2) h JOIN need USING (query) WHERE have = need"""
)
def structured_papers(spark: SparkSession, root: str) -> DataFrame:
    """Papers linked with an author and, if there is one, an institution of each twentieth paper."""
    e = table(spark, root, "edges").where(F.col("edge_type").isin("paper_has_author", "paper_has_institution") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    asked = table(spark, root, "papers").where(F.expr(f"try_cast(substring(paper_id, 2) AS BIGINT) % {EVERY} = 0")).select(F.col("node_id").alias("source_id")).distinct()
    own = e.join(asked, "source_id", "left_semi").select(F.col("source_id").alias("query"), F.col("target_id").alias("entity"), F.when(F.col("edge_type") == "paper_has_author", "author").otherwise("institution").alias("kind"))
    return qr.structured_filter(own, e.select(F.col("source_id").alias("paper"), F.col("target_id").alias("entity")))


_LIKE_KINDS = {"paper_addresses_task": "task", "paper_uses_dataset": "dataset", "paper_uses_method": "method"}
_LIKE = ", ".join(f"'{k}'" for k in _LIKE_KINDS)


@query(
    f"""WITH links AS (SELECT DISTINCT source_id, target_id, edge_type FROM edges WHERE edge_type IN ({_LIKE}) AND source_id IS NOT NULL AND target_id IS NOT NULL),
groups AS (SELECT DISTINCT l.source_id AS query, l.edge_type AS grp, l.target_id FROM links l JOIN papers p ON p.node_id = l.source_id WHERE TRY_CAST(substr(p.paper_id, 2) AS BIGINT) % {EVERY} = 0),
need AS (SELECT query, count(DISTINCT grp) AS need FROM groups GROUP BY 1 HAVING count(DISTINCT grp) >= 2),
have AS (SELECT g.query, l.source_id, count(DISTINCT g.grp) AS have FROM (SELECT DISTINCT source_id, target_id FROM links) l JOIN groups g USING (target_id) GROUP BY 1, 2)
SELECT query, source_id, have FROM have JOIN need USING (query) WHERE have = need"""
)
def constraint_division(spark: SparkSession, root: str) -> DataFrame:
    """Papers that share a task, a dataset and a method with each twentieth paper, as far as it has them (two kinds at least)."""
    e = table(spark, root, "edges").where(F.col("edge_type").isin(list(_LIKE_KINDS)) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("source_id", "target_id", "edge_type").distinct()
    asked = table(spark, root, "papers").where(F.expr(f"try_cast(substring(paper_id, 2) AS BIGINT) % {EVERY} = 0")).select(F.col("node_id").alias("source_id")).distinct()
    groups = e.join(asked, "source_id", "left_semi").select(F.col("source_id").alias("query"), F.col("edge_type").alias("grp"), "target_id")
    several = groups.groupBy("query").agg(F.countDistinct("grp").alias("n")).where(F.col("n") >= 2).select("query")
    return all_constraints(e.select("source_id", "target_id").distinct(), groups.join(several, "query", "left_semi"))


_NUMBER = "^([0-9]+(?:\\.[0-9]+)*|[A-Z](?:\\.[0-9]+)*)\\s+(.+)"
_BEHIND = f"""WITH s AS (SELECT DISTINCT node_id AS section, paper_id AS paper, section_title AS title, section_group AS grp FROM nodes WHERE node_type = 'section' AND section_title IS NOT NULL),
nu AS (SELECT *, regexp_extract(title, '{_NUMBER}', 1) AS number FROM s WHERE regexp_extract(title, '{_NUMBER}', 1) <> ''),
bh AS (SELECT DISTINCT paper, number AS above FROM nu WHERE regexp_matches(regexp_extract(title, '{_NUMBER}', 2), '(?i)\\b(?:related work|background|literature review)\\b')),
ab AS (SELECT section, paper, array_to_string(string_split(number, '.')[1:n], '.') AS above FROM (SELECT *, unnest(range(1, len(string_split(number, '.')) + 1)) AS n FROM nu) x),
behind AS (SELECT DISTINCT section FROM ab JOIN bh USING (paper, above))
"""


def _sections(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "nodes").where((F.col("node_type") == "section") & F.col("section_title").isNotNull())
    return s.select(F.col("node_id").alias("section"), F.col("paper_id").alias("paper"), F.col("section_title").alias("title"), F.col("section_group").alias("grp")).distinct()


@query(
    _BEHIND
    + f"""SELECT s.section, CASE WHEN regexp_matches(l, '{metadata.REFERENCE_TITLE}') THEN 'citation' WHEN regexp_matches(l, '{metadata.ADMIN_TITLE}') THEN 'admin' WHEN b.section IS NOT NULL THEN 'other' WHEN g = 'front_matter' THEN 'metadata'
WHEN g = 'abstract' THEN 'abstract' WHEN g = 'introduction' THEN 'introduction' WHEN g = 'results' OR regexp_matches(l, '{metadata.RESULT_TITLE}') THEN 'results' WHEN g = 'methods' OR regexp_matches(l, '{metadata.METHOD_TITLE}') THEN 'methods'
WHEN g = 'discussion' THEN 'discussion' WHEN g = 'conclusion' THEN 'conclusion' ELSE 'other' END AS role, b.section IS NOT NULL AS background
FROM (SELECT *, {_look('title')} AS l, coalesce(lower(trim(grp)), '') AS g FROM s) s LEFT JOIN behind b USING (section)"""
)
def section_roles(spark: SparkSession, root: str) -> DataFrame:
    """The role of every section for a query; what stands under related work is no method and no result."""
    s = _sections(spark, root)
    behind = qr.background_sections(s).withColumn("background", F.lit(True))
    d = s.join(behind, "section", "left").withColumn("background", F.coalesce("background", F.lit(False)))
    return d.select("section", metadata.role_of(F.col("title"), F.col("grp"), F.col("background")).alias("role"), "background")


@query(
    ORACLE_SQL["section_roles"].replace("SELECT s.section, CASE", ", r AS (SELECT s.section, CASE", 1).rstrip() + f""")
SELECT r.section, f.focus, coalesce(CASE f.focus {' '.join(f"WHEN '{name}' THEN CASE r.role {' '.join(f"WHEN '{role}' THEN {v}" for role, v in zip(metadata.ROLES, row))} END" for name, row in metadata.ROLE_SCORES.items())} END, 0)::DOUBLE AS score
FROM r, (VALUES {', '.join(f"('{name}')" for name in metadata.ROLE_SCORES)}) f(focus)"""
)
def section_role_scores(spark: SparkSession, root: str) -> DataFrame:
    """What each section counts by its role under every focus of a query."""
    roles = section_roles(spark, root).select("section", "role", F.explode(F.array(*[F.lit(n) for n in metadata.ROLE_SCORES])).alias("focus"))
    return roles.select("section", "focus", metadata.role_score(F.col("role"), F.col("focus")).alias("score"))


@query()
def section_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The sections of each paper for a query, at most three, of different roles first, by the focus of the query."""
    nodes = table(spark, root, "nodes")
    nodes = nodes if "section_group" in nodes.columns else nodes.withColumn("section_group", tx.section_group("section_title"))
    rows = nodes.where(F.col("node_type") == "section").select("node_id", "paper_id", "section_title", "section_group", "section_text").distinct()
    texts = rows.select("node_id", F.concat_ws(" ", "section_title", "section_text").alias("text"))
    asked = _cases(spark, root)
    named = _names(spark, root) if "canonical_name" in nodes.columns else spark.createDataFrame([], "entity string, kind string, name string")
    exact = entity_matches(asked, named).groupBy("query").agg(F.collect_set("kind").alias("exact"))
    focused = qr.focus(asked.withColumn("hints", _hints("wording")).join(exact, "query", "left").withColumn("likely", F.array().cast("array<string>"))).select("query", "focus")
    direct = score_documents(texts, asked, key="node_id", text="text", query_key="query", query_text="wording").select("query", F.col("key").alias("section"), "score")
    behind = qr.background_sections(rows.select(F.col("node_id").alias("section"), F.col("paper_id").alias("paper"), F.col("section_title").alias("title"))).withColumn("background", F.lit(True))
    roles = rows.select(F.col("node_id").alias("section"), F.col("paper_id").alias("paper"), "section_title", "section_group").join(behind, "section", "left")
    role = metadata.role_of(F.coalesce("section_title", F.lit("")), F.col("section_group"), F.coalesce("background", F.lit(False)))
    sections = roles.select("section", "paper", role.alias("role"))
    e = table(spark, root, "edges").where(F.col("edge_type").startswith("section_mentions_")).select(F.col("source_id").alias("section"), F.col("target_id").alias("entity"), (F.col("confidence") > 0.95).alias("exact")).distinct()
    ranked = evidence.rank_sections(focused, direct, sections, e)
    return evidence.diversify(ranked, ["query", "paper"], "role", 3)


_HITS = "hits AS (SELECT DISTINCT query_id AS query, paper_id AS paper, node_id AS section, node_id AS key, section_direct_score AS score FROM retrieval_scores WHERE section_direct_score IS NOT NULL AND NOT isnan(section_direct_score) AND paper_id IS NOT NULL AND node_id IS NOT NULL)"


def _hits(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "retrieval_scores").where(F.col("section_direct_score").isNotNull() & ~F.isnan("section_direct_score") & F.col("paper_id").isNotNull() & F.col("node_id").isNotNull())
    return rows.select(F.col("query_id").alias("query"), F.col("paper_id").alias("paper"), F.col("node_id").alias("section"), F.col("node_id").alias("key"), F.col("section_direct_score").alias("score")).distinct()


#: hits of a query that the flat mode looks at: six times the budget of 5 papers, 2 sections and 2 chunks
POOL = 120


@query(
    f"""WITH {_HITS}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS r FROM hits) x WHERE r <= {POOL}),
n AS (SELECT *, row_number() OVER (PARTITION BY query, paper ORDER BY score DESC, key) AS n FROM pool),
s AS (SELECT query, paper, sum(score * CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.72 WHEN 3 THEN 0.55 ELSE 0.38 END::DOUBLE) FILTER (WHERE n <= 4) AS s, max(score) AS best, count(DISTINCT section) AS c FROM n GROUP BY 1, 2),
t AS (SELECT query, paper, round(s + CASE WHEN c > 1 THEN 0.12 * least(c - 1, 3) ELSE 0 END::DOUBLE, 6) AS score, best FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, best DESC, paper) AS place FROM t) x WHERE place <= 5"""
)
def flat_papers(spark: SparkSession, root: str) -> DataFrame:
    """Papers by their best hits, without routing through papers first."""
    pool = rk.top_k(_hits(spark, root), ["query"], [F.desc("score"), F.col("key")], POOL, "_r").drop("_r")
    return qr.flat_papers(pool, 5)


@query(
    f"""WITH {_HITS}, b AS (SELECT query, paper, key, score, 'pages ' || coalesce(CAST(page_start AS VARCHAR), '') AS section FROM hits JOIN (SELECT DISTINCT node_id AS key, page_start FROM nodes WHERE node_type = 'section') p USING (key)),
n AS (SELECT *, row_number() OVER (PARTITION BY query, paper, section ORDER BY score DESC, key) AS n FROM b),
s AS (SELECT query, paper, section, sum(score * CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.68 ELSE 0.5 END::DOUBLE) FILTER (WHERE n <= 3) AS s, count(*) AS c FROM n GROUP BY 1, 2, 3),
t AS (SELECT query, paper, section, round(s + CASE WHEN c > 1 THEN 0.06 * least(c - 1, 3) ELSE 0 END::DOUBLE, 6) AS score FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, paper ORDER BY score DESC, section) AS place FROM t) x WHERE place <= 2"""
)
def flat_sections(spark: SparkSession, root: str) -> DataFrame:
    """Pages of papers by their best hits."""
    pages = table(spark, root, "nodes").where(F.col("node_type") == "section").select(F.col("node_id").alias("key"), "page_start").distinct()
    page = F.concat(F.lit("pages "), F.coalesce(F.col("page_start").cast("string"), F.lit("")))
    return qr.flat_sections(_hits(spark, root).join(pages, "key").withColumn("section", page), 2)


_SIDE = """{n}r AS (SELECT query_id AS query, paper_id AS paper, node_id AS section, max({c}) AS s FROM retrieval_scores WHERE {c} IS NOT NULL AND NOT isnan({c}) AND paper_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2, 3),
{n}p AS (SELECT query, paper, row_number() OVER (PARTITION BY query ORDER BY max(s) DESC, paper) AS place FROM {n}r GROUP BY query, paper),
{n}s AS (SELECT query, paper, section, row_number() OVER (PARTITION BY query, paper ORDER BY s DESC, section) AS place FROM {n}r)"""


def _fused(a: str, b: str, on: str, key: str, part: str, k: int) -> str:
    cols = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in [*on.split(", "), key])
    cond = " AND ".join(f"a.{c} = b.{c}" for c in [*on.split(", "), key])
    return f"""SELECT {on}, {key}, score, place FROM (SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY score DESC, pl NULLS LAST, pr NULLS LAST, {key}) AS place FROM (
  SELECT {cols}, a.place AS pl, b.place AS pr, round(coalesce(0.7 * 61 / (60 + a.place), 0) + coalesce(0.3 * 61 / (60 + b.place), 0), 4)::DOUBLE AS score FROM {a} a FULL JOIN {b} b ON {cond}) x) y WHERE place <= {k}"""


@query(
    "WITH " + _SIDE.format(n="l", c="rank_score") + ", " + _SIDE.format(n="v", c="section_direct_score")
    + f""", a AS (SELECT * FROM lp WHERE place <= 20), b AS (SELECT * FROM vp WHERE place <= 20), ch AS ({_fused('a', 'b', 'query', 'paper', 'query', 5)}),
la AS (SELECT l.* FROM ls l JOIN ch USING (query, paper) WHERE l.place <= 6), lb AS (SELECT v.* FROM vs v JOIN ch USING (query, paper) WHERE v.place <= 6),
se AS ({_fused('la', 'lb', 'query, paper', 'section', 'query', 2)})
SELECT query, paper, ch.score AS paper_score, ch.place AS paper_place, section, se.score, se.place FROM ch JOIN se USING (query, paper)"""
)
def hybrid_sections(spark: SparkSession, root: str) -> DataFrame:
    """Papers of two rankings fused, then the sections inside each."""
    return _hybrid(spark, root)


def _hybrid(spark: SparkSession, root: str) -> DataFrame:
    papers, sections = [], []
    for c in ("rank_score", "section_direct_score"):
        rows = table(spark, root, "retrieval_scores").where(F.col(c).isNotNull() & ~F.isnan(c) & F.col("paper_id").isNotNull() & F.col("node_id").isNotNull())
        r = rows.groupBy(F.col("query_id").alias("query"), F.col("paper_id").alias("paper"), F.col("node_id").alias("section")).agg(F.max(c).alias("s"))
        papers.append(rk.top_k(r.groupBy("query", "paper").agg(F.max("s").alias("s")), ["query"], [F.desc("s"), F.col("paper")], 20).select("query", "paper", "place"))
        sections.append(rk.top_k(r, ["query", "paper"], [F.desc("s"), F.col("section")], 6).select("query", "paper", "section", "place"))
    return rk.hybrid(tuple(papers), tuple(sections), weight=0.3, k=5, k_sections=2)


def _figure_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "nodes").where(F.col("node_type") == "figure").select("node_id", "caption", "section_title").distinct()
    text = F.array_join("caption", " ")
    return rows.select(
        F.col("node_id").alias("figure"), F.try_element_at(F.split("node_id", ":"), F.lit(3)).alias("kind"), F.concat_ws(" ", "section_title", text).alias("body"), text.alias("caption"), tx.reference_label(text).alias("label")
    )


#: fixed values: kinds of assets that words of a query point to
KINDS = {
    "table": ["table"], "plot": ["chart", "image"], "chart": ["chart", "image"], "graph": ["chart", "image"], "curve": ["chart", "image"], "heatmap": ["chart", "image"],
    "scatter": ["chart", "image"], "tsne": ["chart", "image"], "t-sne": ["chart", "image"], "pipeline": ["image", "chart"], "diagram": ["image", "chart"],
    "schematic": ["image", "chart"], "illustration": ["image", "chart"], "figure": ["image", "chart"],
}


def _cases(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "query_cases").where(F.col("query").isNotNull()).select(F.col("query_id").alias("query"), F.col("query").alias("wording")).distinct()
    none = F.array().cast("array<string>")
    wanted = [F.when(F.lower("wording").contains(w), F.array(*[F.lit(k) for k in ks])).otherwise(none) for w, ks in KINDS.items()]
    return rows.withColumn("kinds", F.array_distinct(F.flatten(F.array(*wanted))))


@query()
def figure_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The five figures nearest to each query by text, caption, label, kind and shared words (tested on small cases)."""
    return evidence.rank_figures(_figure_rows(spark, root), _cases(spark, root), 5)


@query()
def figure_support(spark: SparkSession, root: str) -> DataFrame:
    """What papers gain by the figures nearest to each query."""
    ranked = evidence.rank_figures(_figure_rows(spark, root), _cases(spark, root), 20)
    paper = F.concat(F.lit("paper:"), F.try_element_at(F.split("figure", ":"), F.lit(2)))
    return qr.figure_support(ranked.select("query", paper.alias("paper"), "score", F.col("caption_score").alias("caption"), F.col("label_score").alias("label"), "place"))


@query()
def local_figures(spark: SparkSession, root: str) -> DataFrame:
    """The figures of the papers that a query finds first, each paper a corpus of its own (tested on small cases)."""
    best = rk.top_k(_hits(spark, root).groupBy("query", "paper").agg(F.max("score").alias("s")), ["query"], [F.desc("s"), F.col("paper")], 3)
    pairs = best.join(_cases(spark, root), "query").select("query", F.col("paper").alias("part"), "wording")
    rows = table(spark, root, "nodes").where((F.col("node_type") == "figure") & (F.size("caption") > 0))
    records = rows.select(F.col("paper_id").alias("part"), F.col("node_id").alias("record"), F.array_join("caption", " ").alias("text")).distinct()
    return evidence.local_ranking(pairs, records, 2)


def _fuzzy(spark: SparkSession, root: str, cases: DataFrame, k: int = 5) -> DataFrame:
    """(query, entity, kind, score): the k best fuzzily matched entities of each query by n-gram similarity times the weight of their type."""
    names = table(spark, root, "nodes").where(F.col("canonical_name").isNotNull()).select(F.col("node_id").alias("entity"), F.col("node_type").alias("kind"), F.col("canonical_name").alias("name")).distinct()
    got = score_documents(names, cases, key="entity", text="name", query_key="query", query_text="wording")
    typed = got.withColumnRenamed("key", "entity").join(names.groupBy("entity").agg(F.min("kind").alias("kind")), "entity").join(cases.select("query", _hints("wording").alias("hints")), "query")
    weighed = typed.select("query", "entity", "kind", F.round(F.col("score") * qr.fuzzy_weight(F.col("kind"), F.col("hints")), 6).alias("score"), F.col("score").alias("raw")).where(F.col("score") >= 0.02)
    return rk.top_k(weighed, ["query"], [F.desc("score"), F.desc("raw"), F.col("entity")], k).select("query", "entity", "kind", "score")


@query()
def fuzzy_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities whose names are like a query's wording, weighed by what the query asks for."""
    return _fuzzy(spark, root, _cases(spark, root))


@query()
def ranked_papers(spark: SparkSession, root: str) -> DataFrame:
    """Papers for each query from text, titles, handles, entities, coverage, figures, cross-paper support and constraints."""
    cases = _cases(spark, root)
    papers = table(spark, root, "papers").select("node_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    direct = score_documents(papers, cases, key="node_id", text="text", query_key="query", query_text="wording").select("query", F.col("key").alias("paper"), "score")
    names = _names(spark, root)
    matches = entity_matches(cases, names)
    e = table(spark, root, "edges").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    conf = F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    edges = e.where(F.col("edge_type").startswith("paper_")).select(F.col("source_id").alias("paper"), F.col("target_id").alias("entity"), conf)
    inside = e.where(F.col("edge_type").startswith("section_mentions_")).select(F.concat(F.lit("paper:"), F.try_element_at(F.split("source_id", ":"), F.lit(2))).alias("paper"), F.col("source_id").alias("section"), F.col("target_id").alias("entity"), conf)
    parts = phase_one(direct, matches.select("query", "entity", "kind"), edges, inside)
    titles = _papers(spark, root)
    phrased = cases.withColumn("phrases", qr.title_phrases(F.col("wording"))).withColumn("handles", qr.handles(F.col("wording")))
    named = lambda df, name: df.select("query", "paper", F.lit(name).alias("component"), "delta")
    parts = parts.unionByName(named(qr.title_bonus(phrased, titles), "title"))
    parts = parts.unionByName(named(qr.handle_bonus(phrased.where(F.size("phrases") == 0), titles, _figures(spark, root)), "handle"))
    fuzzy = _fuzzy(spark, root, cases).join(edges.groupBy("paper", "entity").agg(F.max("confidence").alias("confidence")), "entity")
    parts = parts.unionByName(fuzzy.select("query", "paper", F.lit("fuzzy").alias("component"), (F.col("score") * F.col("confidence")).alias("delta")))
    pictures = cases.where(qr.is_visual(F.col("wording")))
    ranked = evidence.rank_figures(_figure_rows(spark, root), pictures, 40)
    paper = F.concat(F.lit("paper:"), F.try_element_at(F.split("figure", ":"), F.lit(2)))
    parts = parts.unionByName(named(qr.figure_support(ranked.select("query", paper.alias("paper"), "score", F.col("caption_score").alias("caption"), F.col("label_score").alias("label"), "place")), "figure"))
    parts, cross = settle(parts), settle(cross_edges(spark, root))
    concepts = qr.concept_bonus(matches.join(names, ["entity", "kind"]).select("query", "entity", F.col("name").alias("concept")), _links(spark, root))
    allowed = qr.structured_filter(matches.select("query", "entity", "kind"), edges)
    plain = phrased.where(~qr.is_visual(F.col("wording")) & (F.size("handles") == 0)).select("query", qr.has_conjunction(F.col("wording")).alias("joint"))
    return rank_papers(parts, cross, k=10, third=lambda scores: finish(scores, allowed, concepts, plain))


@query(
    _MATCHES
    + """, aligned AS (SELECT m.query, m.entity, m.score, length(regexp_replace(lower(n.name), '[^a-z0-9一-鿿]+', '', 'g')) >= 4 AND contains(regexp_replace(lower(a.wording), '[^a-z0-9一-鿿]+', '', 'g'), regexp_replace(lower(n.name), '[^a-z0-9一-鿿]+', '', 'g')) AS aligned
  FROM matches m JOIN names n USING (entity, kind) JOIN asked a USING (query))
SELECT query, entity, aligned, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY aligned DESC, score DESC, entity) AS place FROM aligned) x WHERE place <= 4"""
)
def match_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Entities that show why something matches a query."""
    asked, names = asked_texts(spark, root), _names(spark, root)
    m = entity_matches(asked, names).join(names, ["entity", "kind"]).withColumn("source", F.lit("exact"))
    return bundle.match_evidence(m.select("query", "entity", "name", "source", "score"), asked, 4)


#: estimated tokens of a context, as the demonstration of the reference has them
CONTEXT_TOKENS = 800


def _context_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the evidence of each query: papers and sections of two fused rankings, what they hold and mention."""
    found = settle(_hybrid(spark, root).where(F.col("query").isNotNull()))
    papers = table(spark, root, "papers").select(F.col("paper_id").alias("paper"), F.col("node_id").alias("source"), "title", F.array_join("authors", "; ").alias("authors"), F.array_join("institutions", "; ").alias("institutions")).distinct()
    top = found.select("query", "paper", F.col("paper_place").alias("paper_no"), "paper_score").distinct().join(papers, "paper").withColumn("section_no", F.lit(0))
    nodes = table(spark, root, "nodes")
    sections = nodes.where(F.col("node_type") == "section").groupBy(F.col("node_id").alias("section")).agg(*[F.max(c).alias(c) for c in ("section_title", "section_group", "section_text", "page_start", "page_end")])
    held = found.select("query", "paper", F.col("paper_place").alias("paper_no"), "section", F.col("place").alias("section_no"), "score").join(sections, "section")
    out = bundle.lines_of(top, "paper", F.concat(F.lit("\n## Paper "), "paper_no", F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n- paper_id: "), "paper", F.lit("\n- rank_score: "), F.format_string("%.4f", "paper_score")))
    for kind in ("authors", "institutions"):
        out = out.unionByName(bundle.lines_of(top.where(F.length(F.trim(kind)) > 0), kind, F.concat(F.lit(f"- {kind}: "), tx.trim_to(kind, 220))))
    e = table(spark, root, "edges").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    names = nodes.where(F.col("canonical_name").isNotNull()).groupBy(F.col("node_id").alias("target_id")).agg(F.min("node_type").alias("kind"), F.min("canonical_name").alias("name"))
    linked = e.where(F.col("edge_type").startswith("paper_uses_")).groupBy("source_id", "target_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.min("edge_type").alias("edge_type")).join(names, "target_id")
    entities = rk.top_k(top.select("query", "paper_no", "section_no", F.col("source").alias("source_id")).join(linked, "source_id"), ["query", "paper_no"], [F.desc("c"), F.col("target_id")], 5, "item")
    out = out.unionByName(bundle.lines_of(entities, "entity", F.concat(F.lit("  - "), "kind", F.lit(":"), "name", F.lit(" | edge="), "edge_type"), F.col("item"), F.col("c") > 0.95))
    out = out.unionByName(bundle.lines_of(held, "section", F.concat(F.lit("\n### Section: "), F.coalesce("section_title", F.lit("")), F.lit(" ["), F.coalesce("section_group", F.lit("")), F.lit("]\n- section_id: "), "section", F.lit("\n- rank_score: "), F.format_string("%.4f", "score"))))
    filled = held.where(F.length(F.trim("section_text")) > 0)
    out = out.unionByName(bundle.lines_of(filled, "summary", F.concat(F.lit("- summary: "), tx.trim_to("section_text", 220))))
    mentioned = e.where(F.col("edge_type").startswith("section_mentions_")).groupBy(F.col("source_id").alias("section"), "target_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c")).join(names, "target_id")
    inside = rk.top_k(held.select("query", "paper_no", "section_no", "section").join(mentioned, "section"), ["query", "paper_no", "section_no"], [F.desc("c"), F.col("target_id")], 6, "item")
    out = out.unionByName(bundle.lines_of(inside, "section_entity", F.concat(F.lit("  - "), "name"), F.col("item")))
    label = tx.page_label("page_start", "page_end")
    head = F.concat(F.lit("  - ["), "section", F.lit("] "), F.when(label != "", F.concat(F.lit("["), label, F.lit("] "))).otherwise(""))
    parts = filled.withColumn("head", head).select("query", "paper_no", "section_no", "head", F.posexplode(F.slice(F.filter(F.transform(F.split(F.replace("section_text", F.lit("\r"), F.lit("")), r"\n\s*\n+"), tx.normalize_spaces), lambda p: p != ""), 1, 2)).alias("i", "text"))
    out = out.unionByName(bundle.lines_of(parts, "chunk", F.concat("head", tx.trim_to("text", 1100)), F.col("i") + 1))
    figures = nodes.where((F.col("node_type") == "figure") & (F.size("caption") > 0)).groupBy(F.col("node_id").alias("target_id")).agg(F.max(F.array_join("caption", " ")).alias("caption"))
    shown = e.where(F.col("edge_type") == "section_has_figure").select(F.col("source_id").alias("section"), "target_id").distinct().join(figures, "target_id")
    one = rk.top_k(held.select("query", "paper_no", "section_no", "section").join(shown, "section"), ["query", "paper_no", "section_no"], [F.col("target_id")], 1, "item")
    return out.unionByName(bundle.lines_of(one, "figure", F.concat(F.lit("  - ["), "target_id", F.lit("] "), tx.trim_to("caption", 1100)), F.col("item")))


def _trim(c: str, n: int) -> str:
    t = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - 1})) || '…' END"


_UNITS = "len(regexp_extract_all(line, '[一-鿿]|[A-Za-z0-9_]+|[^\\s\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'))"
_LABELLED = "CASE WHEN page_start IS NULL AND page_end IS NULL THEN '' WHEN page_start IS NULL OR page_end IS NULL OR page_start = page_end THEN '[p.' || (coalesce(page_start, page_end) + 1) || '] ' ELSE '[p.' || (page_start + 1) || '-' || (page_end + 1) || '] ' END"
_CONTEXT = (
    ORACLE_SQL["hybrid_sections"].replace("SELECT query, paper, ch.score AS paper_score", ", found AS (SELECT query, paper, ch.score AS paper_score", 1).rstrip() + ")"
    + f""", top AS (SELECT f.query, f.paper, f.paper_place AS paper_no, f.paper_score, p.node_id AS source, p.title, p.a, p.i FROM (SELECT DISTINCT query, paper, paper_place, paper_score FROM found WHERE query IS NOT NULL) f
  JOIN (SELECT DISTINCT paper_id AS paper, node_id, title, array_to_string(authors, '; ') AS a, array_to_string(institutions, '; ') AS i FROM papers) p USING (paper)),
sec AS (SELECT node_id AS section, max(section_title) AS t, max(section_group) AS g, max(section_text) AS txt, max(page_start) AS page_start, max(page_end) AS page_end FROM nodes WHERE node_type = 'section' GROUP BY 1),
held AS (SELECT query, paper_place AS paper_no, section, place AS section_no, score, t, g, txt, page_start, page_end FROM found JOIN sec USING (section) WHERE query IS NOT NULL),
nm AS (SELECT node_id AS target_id, min(node_type) AS kind, min(canonical_name) AS name FROM nodes WHERE canonical_name IS NOT NULL GROUP BY 1),
lk AS (SELECT source_id, target_id, max(coalesce(confidence, 0)) AS c, min(edge_type) AS edge_type FROM edges WHERE edge_type LIKE 'paper_uses_%' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2),
en AS (SELECT query, paper_no, kind, name, edge_type, c, row_number() OVER (PARTITION BY query, paper_no ORDER BY c DESC, target_id) AS item FROM top JOIN lk ON lk.source_id = top.source JOIN nm USING (target_id)),
mn AS (SELECT source_id AS section, target_id, max(coalesce(confidence, 0)) AS c FROM edges WHERE edge_type LIKE 'section_mentions_%' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2),
ie AS (SELECT query, paper_no, section_no, name, row_number() OVER (PARTITION BY query, paper_no, section_no ORDER BY c DESC, target_id) AS item FROM held JOIN mn USING (section) JOIN nm USING (target_id)),
ps AS (SELECT query, paper_no, section_no, section, page_start, page_end, list_filter(list_transform(regexp_split_to_array(replace(txt, chr(13), ''), '\\n\\s*\\n+'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')[1:2] AS pp FROM held WHERE length(trim(txt)) > 0),
pt AS (SELECT query, paper_no, section_no, section, {_LABELLED} AS lab, unnest(pp) AS p, generate_subscripts(pp, 1) AS item FROM ps),
fg AS (SELECT node_id AS target_id, max(array_to_string(caption, ' ')) AS caption FROM nodes WHERE node_type = 'figure' AND len(caption) > 0 GROUP BY 1),
of AS (SELECT query, paper_no, section_no, target_id, caption, row_number() OVER (PARTITION BY query, paper_no, section_no ORDER BY target_id) AS item FROM held JOIN (SELECT DISTINCT source_id AS section, target_id FROM edges WHERE edge_type = 'section_has_figure') s USING (section) JOIN fg USING (target_id)),
l AS (SELECT query, paper_no, 0 AS section_no, 'paper' AS kind, 1 AS item_no, chr(10) || '## Paper ' || paper_no || ': ' || coalesce(title, '') || chr(10) || '- paper_id: ' || paper || chr(10) || '- rank_score: ' || format('{{:.4f}}', paper_score) AS line, FALSE AS sure FROM top
UNION ALL SELECT query, paper_no, 0, 'authors', 1, '- authors: ' || {_trim('a', 220)}, FALSE FROM top WHERE length(trim(a)) > 0
UNION ALL SELECT query, paper_no, 0, 'institutions', 1, '- institutions: ' || {_trim('i', 220)}, FALSE FROM top WHERE length(trim(i)) > 0
UNION ALL SELECT query, paper_no, 0, 'entity', item, '  - ' || kind || ':' || name || ' | edge=' || edge_type, c > 0.95 FROM en WHERE item <= 5
UNION ALL SELECT query, paper_no, section_no, 'section', 1, chr(10) || '### Section: ' || coalesce(t, '') || ' [' || coalesce(g, '') || ']' || chr(10) || '- section_id: ' || section || chr(10) || '- rank_score: ' || format('{{:.4f}}', score), FALSE FROM held
UNION ALL SELECT query, paper_no, section_no, 'summary', 1, '- summary: ' || {_trim('txt', 220)}, FALSE FROM held WHERE length(trim(txt)) > 0
UNION ALL SELECT query, paper_no, section_no, 'section_entity', item, '  - ' || name, FALSE FROM ie WHERE item <= 6
UNION ALL SELECT query, paper_no, section_no, 'chunk', item, '  - [' || section || '] ' || lab || {_trim('p', 1100)}, FALSE FROM pt
UNION ALL SELECT query, paper_no, section_no, 'figure', item, '  - [' || target_id || '] ' || {_trim('caption', 1100)}, FALSE FROM of WHERE item <= 1),
ev AS (SELECT *, {_UNITS} AS units, least(CASE WHEN kind = 'entity' AND NOT sure THEN 1 WHEN kind = 'institutions' THEN 2 WHEN kind = 'authors' THEN 3 WHEN kind = 'chunk' AND item_no > 1 THEN 7 WHEN kind = 'section_entity' THEN 8 WHEN kind = 'summary' THEN 9
    WHEN kind = 'chunk' THEN 12 WHEN kind = 'figure' THEN 14 ELSE 99 END, CASE WHEN section_no > 1 THEN 11 ELSE 99 END, CASE WHEN paper_no > 1 THEN 15 ELSE 99 END) AS rule FROM l WHERE length(line) > 0),
e2 AS (SELECT *, CASE WHEN rule = 15 THEN 0 ELSE section_no END AS s, CASE WHEN rule IN (11, 15) THEN 0 ELSE item_no END AS i FROM ev),
sz AS (SELECT query, rule, paper_no, s, i, sum(units) AS n FROM e2 GROUP BY 1, 2, 3, 4, 5),
lf AS (SELECT *, sum(n) OVER (PARTITION BY query) - coalesce(sum(n) OVER (PARTITION BY query ORDER BY rule, paper_no DESC, s DESC, i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM sz),
kept AS (SELECT e2.* FROM e2 JOIN lf USING (query, rule, paper_no, s, i) WHERE NOT (remaining > {int(CONTEXT_TOKENS / 0.9 + 1e-9)} AND rule < 99))
"""
)


@query(_CONTEXT + "SELECT query, CAST(paper_no AS INT) AS paper_no, CAST(section_no AS INT) AS section_no, kind, CAST(item_no AS INT) AS item_no, line FROM kept")
def context_lines(spark: SparkSession, root: str) -> DataFrame:
    """The evidence of each query that fits into 800 estimated tokens."""
    kept = bundle.shrink(_context_lines(spark, root), CONTEXT_TOKENS)
    return kept.select("query", F.col("paper_no").cast("int").alias("paper_no"), F.col("section_no").cast("int").alias("section_no"), "kind", "item_no", "line")


@query(_CONTEXT + "SELECT query, count(*) AS n_lines, count(DISTINCT paper_no) AS n_papers, count(DISTINCT CASE WHEN section_no > 0 THEN paper_no * 10 + section_no END) AS n_sections, count(CASE WHEN kind = 'chunk' THEN 1 END) AS n_chunks, count(CASE WHEN kind = 'figure' THEN 1 END) AS n_figures, CAST(sum(units) AS BIGINT) AS units FROM kept GROUP BY 1")
def context_summary(spark: SparkSession, root: str) -> DataFrame:
    """What the context of each query holds."""
    kept = bundle.shrink(_context_lines(spark, root), CONTEXT_TOKENS)
    of = lambda k: F.count_if(F.col("kind") == k)
    inside = F.countDistinct(F.when(F.col("section_no") > 0, F.col("paper_no") * 10 + F.col("section_no")))
    return kept.groupBy("query").agg(F.count("*").alias("n_lines"), F.countDistinct("paper_no").alias("n_papers"), inside.alias("n_sections"), of("chunk").alias("n_chunks"), of("figure").alias("n_figures"), F.sum("units").cast("bigint").alias("units"))


@query()
def context_bundles(spark: SparkSession, root: str) -> DataFrame:
    """The context of each query as one text (its lines are those of context_lines)."""
    asked = table(spark, root, "query_cases").where(F.col("query").isNotNull()).select(F.col("query_id").alias("query"), F.col("query").alias("wording")).distinct()
    return bundle.render(bundle.shrink(_context_lines(spark, root), CONTEXT_TOKENS), asked)
