"""Queries of the operators for training data, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.llm.bpe import count_tokens, encode_texts
from foliograph.llm.harmful import fit, score_documents
from foliograph.llm.linkage import match_citations
from foliograph.llm.one_ranking import combine_scores, top_items
from foliograph.llm.packing import pack
from foliograph.llm.scans import Scans, defects, examine, repair
from foliograph.llm.splitting import split_oversized
from foliograph.llm.variants import entity_pairs, group_variants
from foliograph.sources.store import row_bound, table


def _limits(spark: SparkSession, root: str, use: str) -> tuple[int, int]:
    """max_size and overlap_size of one use; the table has one row per use."""
    row = table(spark, root, "size_limits").where(F.col("use_name") == use).select("max_size", "overlap_size").first()
    return row[0], row[1]


def p1_entities(spark: SparkSession, root: str) -> DataFrame:
    """Every record that names a person or an organisation, with its entity."""
    nodes = table(spark, root, "nodes").select("node_id", "node_type", "canonical_name", "institution_text")
    papers = table(spark, root, "papers").select("paper_id", "authors")

    def named(kind: str, node_type: str, column: str) -> DataFrame:
        return nodes.where(F.col("node_type") == node_type).select(F.col("node_id").alias("rec"), F.lit(kind).alias("kind"), F.col(column).alias("name"))

    entries = papers.select("paper_id", F.posexplode("authors").alias("i", "name")).select(
        F.concat("paper_id", F.lit("#"), F.col("i") + 1).alias("rec"), F.lit("person").alias("kind"), "name"
    )
    records = (
        named("person", "author", "canonical_name")
        .unionByName(entries)
        .unionByName(named("organisation", "institution", "canonical_name"))
        .unionByName(named("organisation", "paper", "institution_text"))
    )
    return group_variants(records)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of records that name the same person or organisation."""
    return entity_pairs(p1_entities(spark, root))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of every oversized block and section."""
    parts = []
    for name, key, text, use in (
        ("paper_content_list", "block_id", "text", "split_item"),
        ("nodes", "node_id", "section_text", "split_section"),
    ):
        limit, overlap = _limits(spark, root, use)
        got = split_oversized(table(spark, root, name).select(key, text), key=key, text=text, limit=limit, overlap=overlap)
        parts.append(got.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("rec_id"), "piece_no", "start", "end", "piece"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that had to be split."""
    return p2_pieces(spark, root).where(F.col("piece_no") == 2).select("src_table", "rec_id")


def p2_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """Texts put together again from their pieces, each less the overlap with the one before, as a hash."""
    rows = p2_pieces(spark, root)
    before = F.lag("end").over(W.partitionBy("src_table", "rec_id").orderBy("piece_no"))
    own = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    own = own.withColumn("own", F.expr("substring(piece, greatest(before - start, 0) + 1)"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"])
    return own.groupBy("src_table", "rec_id").agg(F.md5(F.array_join(parts, "")).alias("text_md5"))


def p3_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The combined score of every candidate section of every query."""
    scores = table(spark, root, "retrieval_scores").select(
        "query_id", "node_id", "rank_score", "paper_direct_score", "section_direct_score", "scored_at"
    )
    signs = {"rank_score": 1, "paper_direct_score": 1, "section_direct_score": 1}
    return combine_scores(scores, group="query_id", item="node_id", scores=signs, latest="scored_at")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The first ten sections of each query."""
    return top_items(p3_ranking(spark, root), group="query_id", item="node_id", k=10).select("query_id", "node_id")


def _scanned(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Texts of scanned papers (src_table, rec_id, text, title), and texts of the others (text)."""
    papers = table(spark, root, "papers").groupBy("paper_id").agg(
        F.max("title").alias("title"), F.max(F.array_contains("metadata_sources", "scan")).alias("scan")
    )
    blocks = table(spark, root, "paper_content_list").where(F.col("text").isNotNull() & F.col("text_level").isNull())
    blocks = blocks.select(F.lit("paper_content_list").alias("src_table"), F.col("block_id").cast("string").alias("rec_id"), "paper_id", "text")
    figures = table(spark, root, "nodes").where((F.col("node_type") == "figure") & (F.size("caption") > 0))
    figures = figures.select(F.lit("nodes").alias("src_table"), F.col("node_id").alias("rec_id"), "paper_id", F.array_join("caption", "\n\n").alias("text"))
    # the papers' side is joined in once; a row goes to one of the two sides by its paper
    known = blocks.unionByName(figures).join(papers, "paper_id", "left")
    scanned = known.where("scan").select("src_table", "rec_id", "text", "title").dropDuplicates(["src_table", "rec_id"])
    return scanned, known.where("NOT coalesce(scan, false)").select("text")


def _examined(spark: SparkSession, root: str) -> tuple[DataFrame, Scans]:
    scanned, clean = _scanned(spark, root)
    venues = table(spark, root, "nodes").where(F.col("node_type") == "venue").select(F.col("canonical_name").alias("name"))
    return scanned, examine(scanned, clean, table(spark, root, "scan_samples"), venues)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records of scanned papers and what is wrong with them."""
    return defects(_examined(spark, root)[1])


def p5_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The repaired texts of scanned papers."""
    return repair(*_examined(spark, root))


def p6_matches(spark: SparkSession, root: str) -> DataFrame:
    """Citations with the paper they cite and the confidence of the match."""
    nodes = table(spark, root, "nodes").where(F.col("node_type") == "reference")
    citations = nodes.select(
        F.col("node_id").alias("key"),
        F.col("citation_title").alias("title"),
        F.col("citation_year").alias("year"),
        F.col("citation_author_text").alias("authors"),
    )
    papers = table(spark, root, "papers").select(F.col("paper_id").alias("key"), "title", "year", "authors")
    return match_citations(citations, papers).select(F.col("key").alias("node_id"), F.col("paper").alias("paper_id"), "confidence")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Citations and the papers they cite."""
    return p6_matches(spark, root).select("node_id", "paper_id")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, root, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every document, or of every piece of a document above the capacity."""
    capacity, _ = _limits(spark, root, "pack_documents")
    documents = table(spark, root, "documents")
    sizes = count_tokens(documents, "doc_id", "text")
    return pack(sizes, key="doc_id", size="n_tokens", capacity=capacity, rows=row_bound(documents))


def p9_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents as the containers hold them: how often each is there as a whole, and how many containers exceed the capacity (none may)."""
    capacity, _ = _limits(spark, root, "pack_documents")
    rows = p9_containers(spark, root)
    full = rows.groupBy("container").agg(F.sum("n_tokens").alias("n")).withColumn("over", F.col("n") > capacity).select("container", "over")
    return rows.join(full, "container").groupBy("doc_id").agg(F.max(F.col("over").cast("int")).alias("too_full"))


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its score for abusive, hateful or sexual content."""
    documents = table(spark, root, "documents")
    model = fit(documents, table(spark, root, "doc_labels"), key="doc_id", text="text", label="harmful")
    return score_documents(documents, model, key="doc_id", text="text", keep=["source"])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold such content."""
    return p10_scores(spark, root).where("harmful").select("doc_id").distinct()


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents, harmful documents and their rate per source."""
    return (
        p10_scores(spark, root)
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count_if("harmful").alias("n_harmful"))
        .withColumn("rate", F.round(F.col("n_harmful") / F.col("n_docs"), 6))
    )


QUERIES = {
    "p1_entities": p1_entities,
    "p1_found": p1_found,
    "p2_pieces": p2_pieces,
    "p2_found": p2_found,
    "p2_rebuilt": p2_rebuilt,
    "p3_ranking": p3_ranking,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_matches": p6_matches,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_documents": p9_documents,
    "p10_scores": p10_scores,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

ORACLE_SQL = {
    "p2_found": """
SELECT DISTINCT 'paper_content_list' AS src_table, CAST(block_id AS VARCHAR) AS rec_id FROM paper_content_list
WHERE length(text) > (SELECT max_size FROM size_limits WHERE use_name = 'split_item')
UNION ALL
SELECT DISTINCT 'nodes' AS src_table, node_id AS rec_id FROM nodes
WHERE length(section_text) > (SELECT max_size FROM size_limits WHERE use_name = 'split_section')""",
    "p2_rebuilt": """
SELECT 'paper_content_list' AS src_table, CAST(block_id AS VARCHAR) AS rec_id, md5(max(text)) AS text_md5 FROM paper_content_list
WHERE length(text) > (SELECT max_size FROM size_limits WHERE use_name = 'split_item') GROUP BY block_id
UNION ALL
SELECT 'nodes' AS src_table, node_id AS rec_id, md5(max(section_text)) AS text_md5 FROM nodes
WHERE length(section_text) > (SELECT max_size FROM size_limits WHERE use_name = 'split_section') GROUP BY node_id""",
    "p9_documents": "SELECT DISTINCT doc_id, 0 AS too_full FROM documents WHERE doc_id IS NOT NULL",
}
