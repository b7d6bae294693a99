"""What a query asks for, read from its wording, and what that is worth to papers.

Queries are a stated set: rules between a query and all papers that no key can join
(containment of titles) take the queries in blocks that are sent to the papers, BLOCK at
a time, so what is sent does not grow. All other rules are equi-joins; handles meet
texts by their rarest piece of four characters.

Defined cases: null wordings are left out; a query without a phrase, handle or concept
gets no row from the rule; of several rules for one paper the highest bonus counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators.ranking import top_k
from foliograph.sources.store import row_bound, settle

#: queries sent to the papers at a time
BLOCK = 2000
#: fixed values: words that ask for pictures, explanations, lists and searches; quotes, tokens and spans like titles
VISUAL = (
    r"\b(?:image|images|figure|figures|fig|diagram|diagrams|table|tables|chart|charts|plot|plots|visual|visuals|visualization|visualizations|visualisation|visualisations|"
    r"pipeline|workflow|overview|architecture|layout|matrix|schematic|illustration|tsne|t-sne|scatter|heatmap)\b"
)
SHOWN_GRAPH = r"\b(?:show|display|draw)\b.{0,60}\bgraph\b"
EXPLAINS = r"\b(?:explain|how|why|compare|differ|differences?|mechanism|architecture|workflow)\b"
NAMES_SOURCE = r"\b(?:explain|describe|summari[sz]e|how|why|what|compare|contrast|differ(?:s|ences?)?|show)\b"
CITES = r"\b(?:cit(?:e[sd]?|ing|ations?)|references? to)\b"
LISTS = r"\b(?:which|what)\s+papers\b|\blist\s+(?:all\s+)?(?:the\s+)?papers\b"
SEARCHES = r"\b(?:find|show|locate|look up|lookup)\b"
QUOTED = "[\"“”'‘’](.+?)[\"“”'‘’]"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9.+\-/]*"
TITLE_SPAN = r"[A-Z0-9][A-Za-z0-9][A-Za-z0-9 .:+\-/,&()']{4,}"
REQUEST = r"(?i)^(?:find me|find|show me|show|look up|lookup|please find|please show|i want to see|i want|see)\s+"
STRUCTURED, SEMANTIC, METADATA = ["author", "institution", "reference", "venue"], ["method", "dataset", "task", "metric", "model"], ["author", "institution", "venue"]
#: fixed values: bonuses of titles and of handles, and what is taken from the papers a title query does not mean
PREFIX_TITLE, WHOLE_TITLE, PART_TITLE, TITLE_AGAIN, OTHER_TITLES, OTHER_TITLES_MANY = 168.0, 120.0, 52.0, 6.0, -34.0, -24.0
ONLY_HANDLE, PREFIX_HANDLE, WHOLE_HANDLE, PART_HANDLE, FIGURE_HANDLE = 340.0, 180.0, 110.0, 96.0, 48.0
#: fixed values: weights of fuzzy entities by the focus of the query
FUZZY = {"asked": 1.35, "semantic_off": 0.42, "reference_off": 0.22, "other_off": 0.18, "semantic_near": 0.86, "reference_near": 0.2, "other_near": 0.12, "reference": 0.9}


def is_visual(c: Column) -> Column:
    """Asks for a picture; a graph as a structure does not by itself."""
    return c.rlike(f"(?i){VISUAL}") | c.rlike(f"(?i){SHOWN_GRAPH}")


def is_list(c: Column) -> Column:
    """Asks for all papers of a kind."""
    return tx.normalize_spaces(c).rlike(f"(?i){LISTS}")


def has_conjunction(c: Column) -> Column:
    """Joins concepts by and, with or plus."""
    return F.lower(c).rlike(" and | with | plus ")


def quoted_spans(c: Column) -> Column:
    """Texts in quotation marks."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(QUOTED), 1), tx.normalize_spaces), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Words, numbers and handles."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def word_ngrams(c: Column, longest: int) -> Column:
    """Lookup forms of all runs of at most `longest` tokens, each once."""
    words = tokens(c)
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.least(size, F.lit(longest)), F.lit(1))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: tx.lookup_text(F.array_join(F.slice(words, i, n), " "))))
    return F.filter(F.array_distinct(F.flatten(runs)), lambda w: w != "")


def handles(c: Column) -> Column:
    """Tokens like names of systems: inner capitals, all capitals, or hyphens with a capital; of at least four letters or digits."""
    odd = lambda t: F.substring(t, 2, 400).rlike("[A-Z]") | (t.rlike("[A-Z]") & (F.upper(t) == t)) | (t.contains("-") & t.rlike("[A-Z]"))
    return F.filter(tokens(c), lambda t: (F.length(tx.compact_text(t)) >= 4) & odd(t))


def title_phrases(c: Column) -> Column:
    """Spans of a query that look like titles: quoted or named ones if it speaks of a title, and those before "this paper"."""
    clean = lambda s: tx.normalize_spaces(F.regexp_replace(F.regexp_replace(tx.normalize_spaces(s), r"^[ ,.;:!?()\[\]{}]+|[ ,.;:!?()\[\]{}]+$", ""), REQUEST, ""))
    like = lambda s: (F.length(tx.compact_text(s)) >= 8) & ((F.size(tokens(s)) >= 2) | s.rlike(r"[:()-]"))
    none = F.array().cast("array<string>")
    named = F.filter(F.array(F.regexp_extract(c, r"(?i)(?:paper|paper title|title)\s*(?:is|=|:)?\s*(.+?)\s*(?:paper)?[?]?\s*$", 1)), lambda s: s != "")
    explicit = F.when(F.lower(c).contains("title"), F.concat(quoted_spans(c), named)).otherwise(none)
    cue = r"(?i)(?:this\s+paper|these\s+papers?|the\s+paper)"
    before = F.regexp_extract_all(F.element_at(F.split(c, cue, 2), 1), F.lit(f"({TITLE_SPAN})"), 1)
    spans = F.when(c.rlike(cue) & ~is_list(c), F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), 3)).otherwise(none)
    return F.array_distinct(F.filter(F.transform(F.concat(explicit, spans), clean), like))


def focus(asked: DataFrame) -> DataFrame:
    """`asked` (query, wording, hints, exact, likely: arrays of entity types) with what kind of sections the query wants.

    hints: types its words point to; exact, likely: types of entities matched exactly and by a good score.
    """
    both = lambda column, types: F.array_intersect(F.coalesce(column, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in types]))
    first = lambda *arrays: F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))
    d = asked.withColumn("semantic_types", first(both(F.col("hints"), SEMANTIC), both(F.col("exact"), SEMANTIC), both(F.col("likely"), SEMANTIC)))
    d = d.withColumn("structured_types", first(both(F.col("hints"), STRUCTURED), both(F.col("exact"), METADATA)))
    meta, some = F.size(both(F.col("structured_types"), METADATA)) > 0, F.size("semantic_types") > 0
    only_reference = F.array_contains(F.coalesce("exact", F.array().cast("array<string>")), "reference") & ~some & ~meta
    reference = F.array_contains("structured_types", "reference") | only_reference
    semantic = some | (F.col("wording").rlike(f"(?i){EXPLAINS}") & ~meta & ~reference)
    d = d.withColumn("reference_query", reference).withColumn("semantic_query", semantic)
    d = d.withColumn("metadata_query", meta & ~F.col("semantic_query") & ~F.col("reference_query")).withColumn("mixed_query", meta & F.col("semantic_query"))
    kind = F.when(F.col("mixed_query"), "mixed").when(F.col("semantic_query"), "semantic").when(F.col("reference_query"), "reference").when(F.col("metadata_query"), "metadata").otherwise("default")
    return d.withColumn("focus", kind)


def fuzzy_weight(kind: Column, hints: Column) -> Column:
    """What a fuzzily matched entity of a type counts under the types a query points to."""
    of = lambda types: F.size(F.array_intersect(hints, F.array(*[F.lit(t) for t in types]))) > 0
    semantic, asked, reference = kind.isin(SEMANTIC), F.array_contains(hints, kind), kind == "reference"
    off = F.when(asked & kind.isin(STRUCTURED), FUZZY["asked"]).when(semantic, FUZZY["semantic_off"]).when(reference, FUZZY["reference_off"]).otherwise(FUZZY["other_off"])
    near = F.when(asked & semantic, FUZZY["asked"]).when(semantic, FUZZY["semantic_near"]).when(reference, FUZZY["reference_near"]).otherwise(FUZZY["other_near"])
    return F.when(of(STRUCTURED), off).when(of(SEMANTIC), near).otherwise(F.when(reference, FUZZY["reference"]).otherwise(1.0))


def in_blocks(asked: DataFrame, key: str, f) -> DataFrame:
    """f(block) over blocks of at most about BLOCK stated queries, united."""
    n = max(1, -(-row_bound(asked.select(key).distinct()) // BLOCK))
    out: DataFrame | None = None
    for b in range(n):
        part = f(F.broadcast(asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) if n > 1 else asked))
        out = part if out is None else out.unionByName(part)
    return out


def _titles(papers: DataFrame) -> DataFrame:
    prefix = F.substring_index("title", ":", 1)
    return papers.where(F.length(F.trim("title")) > 0).select(
        "paper", tx.lookup_text("title").alias("t"), tx.compact_text("title").alias("tc"), tx.lookup_text(prefix).alias("p"), tx.compact_text(prefix).alias("pc")
    )


def title_bonus(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(query, paper, delta) of the papers whose titles a query names; asked: query, phrases; papers: paper, title."""
    targets = asked.select("query", F.explode("phrases").alias("phrase")).select("query", tx.lookup_text("phrase").alias("x"), tx.compact_text("phrase").alias("xc")).where(F.col("xc") != "").dropDuplicates(["query", "xc"])
    inside = (F.length("xc") >= 10) & (F.col("t").contains(F.col("x")) | F.col("x").contains(F.col("t")) | F.col("tc").contains(F.col("xc")) | F.col("xc").contains(F.col("tc")))
    bonus = F.when((F.col("p") == F.col("x")) | (F.col("pc") == F.col("xc")), PREFIX_TITLE).when((F.col("t") == F.col("x")) | (F.col("tc") == F.col("xc")), WHOLE_TITLE).when(inside, PART_TITLE)
    titles = _titles(papers)
    hits = in_blocks(targets, "query", lambda block: titles.join(block, bonus.isNotNull()).select("query", "paper", bonus.alias("b")))
    return hits.groupBy("query", "paper").agg((F.max("b") + TITLE_AGAIN).alias("delta"))


def title_isolation(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, delta): what every paper but the named ones loses, for queries that name a title."""
    size = asked.select("query", F.when(F.size("phrases") <= 2, OTHER_TITLES).otherwise(OTHER_TITLES_MANY).alias("delta"))
    return size.join(hits.select("query").distinct(), "query", "left_semi")


#: letters of the pieces by which handles meet texts; a handle has at least as many
PIECE = 4


def _pieces(c: Column) -> Column:
    """All runs of PIECE characters of a text, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (PIECE - 1)), lambda i: F.substring(c, i, F.lit(PIECE))))


def holding(handles: DataFrame, texts: DataFrame) -> DataFrame:
    """(xc, tc) of all distinct compact texts that hold a distinct compact handle of at least PIECE characters.

    A text that holds a handle holds all pieces of it; they meet by the one that the fewest texts hold.
    """
    x, t = handles.select("xc").distinct(), texts.select("tc").where(F.length("tc") >= PIECE).distinct()
    cut = x.select("xc", F.explode(_pieces(F.col("xc"))).alias("piece"))
    there = t.select("tc", F.explode(_pieces(F.col("tc"))).alias("piece"))
    n = there.join(cut.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    # a piece that no text holds leaves the handle without one, which is right
    rarest = cut.join(n, "piece", "left").groupBy("xc").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("b")).select("xc", F.col("b.piece").alias("piece"))
    return there.join(rarest, "piece").where(F.contains("tc", F.col("xc"))).select("xc", "tc")


def handle_bonus(asked: DataFrame, papers: DataFrame, figures: DataFrame) -> DataFrame:
    """(query, paper, delta) of papers whose titles or figures hold a handle of the query; asked: query, handles; figures: paper, text.

    What holds a handle in lookup form, or is equal to it, holds or equals it in compact form, too.
    """
    variants = asked.select("query", F.explode("handles").alias("h")).select("query", F.explode(tx.lookup_variants("h")).alias("x")).select("query", tx.compact_text("x").alias("xc"))
    variants = settle(variants.where(F.length("xc") >= PIECE).distinct())
    titles = _titles(papers).select("paper", "tc", "pc")
    prefix = F.col("pc") == F.col("xc")
    bonus = F.when(prefix, PREFIX_HANDLE).when(F.col("tc") == F.col("xc"), WHOLE_HANDLE).otherwise(PART_HANDLE)
    hits = settle(holding(variants, titles).join(titles, "tc").select("xc", "paper", bonus.alias("b"), prefix.alias("first")))
    # a handle that begins one title only means that paper
    alone = hits.where("first").groupBy("xc").agg(F.count("*").alias("n"), F.max("paper").alias("paper")).where(F.col("n") == 1).select("xc", "paper", F.lit(ONLY_HANDLE).alias("b"))
    texts = figures.where(F.length("text") > 0).select("paper", tx.compact_text("text").alias("tc")).distinct()
    shown = holding(variants, texts).join(texts, "tc").select("xc", "paper", F.lit(FIGURE_HANDLE).alias("b")).distinct()
    every = hits.select("xc", "paper", "b").unionByName(alone).unionByName(shown).groupBy("xc", "paper").agg(F.max("b").alias("b"))
    return variants.join(every, "xc").groupBy("query", "paper").agg(F.max("b").alias("delta"))


def named_sources(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(query, paper): papers that an explaining query names by a whole title or by the part before its colon, where only one paper has it.

    A query that lists papers or speaks of citations names none. An alias is met by its
    longest word, which stands in the query as a whole word if the alias does.
    """
    title = F.trim("title")
    prefix = F.trim(F.substring_index(title, ":", 1))
    short = title.contains(":") & F.length(prefix).between(3, 48) & (F.size(F.split(prefix, r"\s+")) <= 4)
    names = F.filter(F.array(F.when(F.length(title) >= 8, F.lower(title)), F.when(short, F.lower(prefix))), lambda a: a.isNotNull())
    aliases = papers.select("paper", F.explode(names).alias("alias")).distinct()
    single = aliases.groupBy("alias").agg(F.count("*").alias("n"), F.max("paper").alias("paper")).where(F.col("n") == 1)
    word = r"([\p{L}\p{N}_]+)"
    longest = lambda a: F.array_max(F.transform(F.regexp_extract_all(a, F.lit(word), 1), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = single.withColumn("word", longest(F.col("alias"))).where(F.col("word").isNotNull())
    speaks = F.col("wording").rlike(f"(?i){NAMES_SOURCE}") & ~is_list(F.col("wording")) & ~F.col("wording").rlike(f"(?i){CITES}")
    low = asked.where(speaks).select("query", F.lower("wording").alias("low"))
    words = low.select("query", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(word), 1))).alias("word"))
    bare = r"[^\p{L}\p{N}_]"
    found = F.regexp_like("low", F.concat(F.lit(rf"(^|{bare})\Q"), F.col("alias"), F.lit(rf"\E($|{bare})")))
    return words.join(keyed, "word").where(found).select("query", "paper").distinct()


def structured_filter(matches: DataFrame, links: DataFrame) -> DataFrame:
    """(query, paper) allowed by a query's exact authors, institutions, venues and references: linked with one of each type it names.

    matches: query, entity, kind of the types asked for; links: paper, entity. Papers of
    such queries that are not allowed lose 24, the others gain .35.
    """
    held = matches.where(F.col("kind").isin(STRUCTURED)).select("query", "entity", "kind").distinct()
    per_type = held.join(links.select("paper", "entity").distinct(), "entity").select("query", "kind", "paper").distinct()
    need = per_type.groupBy("query").agg(F.countDistinct("kind").alias("need"))
    have = per_type.groupBy("query", "paper").agg(F.count("*").alias("have"))
    return have.join(need, "query").where(F.col("have") == F.col("need")).select("query", "paper")


def concept_bonus(matches: DataFrame, links: DataFrame) -> DataFrame:
    """(query, paper, covered, concepts, delta) of papers by how many of a query's concepts they cover.

    matches: query, concept, entity; links: paper, entity. Each concept gives 1.2, each
    further one 1.6 more, all of them 4.8 + 1.4 n, the leader with at least two 2.
    """
    total = matches.groupBy("query").agg(F.countDistinct("concept").alias("concepts"))
    covered = matches.join(links.select("paper", "entity").distinct(), "entity").groupBy("query", "paper").agg(F.countDistinct("concept").alias("covered"))
    most = covered.groupBy("query").agg(F.max("covered").alias("most"))
    c, n = F.col("covered"), F.col("concepts")
    more = F.when(c == n, 4.8 + 1.4 * n).when((c == F.col("most")) & (c >= 2), 2.0).otherwise(0.0)
    delta = 1.2 * c + F.when(c >= 2, 1.6 * (c - 1)).otherwise(0.0) + more
    return covered.join(total, "query").join(most, "query").select("query", "paper", "covered", "concepts", F.round(delta, 6).alias("delta"))


def background_sections(sections: DataFrame) -> DataFrame:
    """(section) of sections under a heading of related work, told by dotted numbers; sections: section, paper, title.

    A heading 2.1.3 stands under 2.1 and 2 of the same paper; a parent without a row tells nothing.
    """
    number = F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\s+(.+)", 1)
    numbered = sections.withColumn("number", number).where(F.col("number") != "")
    behind = numbered.where(F.regexp_extract("title", r"^(?:[0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\s+(.+)", 1).rlike(r"(?i)\b(?:related work|background|literature review)\b")).select("paper", F.col("number").alias("above")).distinct()
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return numbered.select("section", "paper", F.explode(above).alias("above")).join(behind, ["paper", "above"], "left_semi").select("section").distinct()


def figure_support(ranked: DataFrame) -> DataFrame:
    """(query, paper, delta) from figures ranked for a query (query, paper, score, caption, label, place from 1)."""
    # fixed values: 72 times the score less .08 a place down to .45, 10 for the caption, 4 for the label
    discount = F.greatest(F.lit(0.45), 1 - 0.08 * (F.col("place") - 1))
    bonus = 72.0 * F.col("score") * discount + 10.0 * F.col("caption") + 4.0 * F.col("label")
    return ranked.groupBy("query", "paper").agg(F.round(F.sum(bonus), 5).alias("delta"))


def flat_papers(hits: DataFrame, k: int) -> DataFrame:
    """(query, paper, score, best, place) of papers by their best four of a query's hits (query, paper, section, key, score).

    Weights 1, .72, .55, .38, and .12 for each further section, at most three.
    """
    best = top_k(hits, ["query", "paper"], [F.desc("score"), F.col("key")], 4, "_n")
    weighed = best.groupBy("query", "paper").agg(F.sum(F.col("score") * F.element_at(F.array(*[F.lit(w) for w in (1.0, 0.72, 0.55, 0.38)]), F.col("_n"))).alias("s"), F.max("score").alias("best"))
    spread = hits.groupBy("query", "paper").agg(F.countDistinct("section").alias("sections"))
    total = F.round(F.col("s") + F.when(F.col("sections") > 1, 0.12 * F.least(F.col("sections") - 1, F.lit(3))).otherwise(0.0), 6)
    scored = weighed.join(spread, ["query", "paper"]).select("query", "paper", total.alias("score"), "best")
    return top_k(scored, ["query"], [F.desc("score"), F.desc("best"), F.col("paper")], k)


def flat_sections(hits: DataFrame, k: int) -> DataFrame:
    """(query, paper, section, score, place) of sections by their best three hits: weights 1, .68, .5, and .06 for each further hit, at most three."""
    best = top_k(hits, ["query", "paper", "section"], [F.desc("score"), F.col("key")], 3, "_n")
    weighed = best.groupBy("query", "paper", "section").agg(F.sum(F.col("score") * F.element_at(F.array(*[F.lit(w) for w in (1.0, 0.68, 0.5)]), F.col("_n"))).alias("s"))
    count = hits.groupBy("query", "paper", "section").agg(F.count("*").alias("n"))
    total = F.round(F.col("s") + F.when(F.col("n") > 1, 0.06 * F.least(F.col("n") - 1, F.lit(3))).otherwise(0.0), 6)
    scored = weighed.join(count, ["query", "paper", "section"]).select("query", "paper", "section", total.alias("score"))
    return top_k(scored, ["query", "paper"], [F.desc("score"), F.col("section")], k)
