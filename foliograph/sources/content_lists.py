"""Reading parsed papers (JSON content lists, JSON lines) and writing graph tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions.text import normalize_text

#: one parsed block; captions and the page have several names in the wild
ITEM = (
    "type string, sub_type string, text string, content string, text_level int, page_idx int, page_no int, page int, bbox array<double>, img_path string, "
    "list_items array<string>, image_caption array<string>, chart_caption array<string>, table_caption array<string>, image_footnote array<string>, table_body string"
)
PAYLOAD_KEYS = ("content_list", "data", "items", "result")


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, item_index, fields of ITEM) of every *content_list*.json below paper folders.

    A file is a bare list of items or an object that holds the list under one of
    PAYLOAD_KEYS; the folder's name is the paper. Folders that begin with a dot are left out.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*content_list*.json").select("value", F.col("_metadata.file_path").alias("file"))
    folder = F.element_at(F.split("file", "/"), -2)
    bare = F.from_json("value", f"array<struct<{_fields(ITEM)}>>")
    held = F.from_json("value", f"struct<{','.join(f'{k}:array<struct<{_fields(ITEM)}>>' for k in PAYLOAD_KEYS)}>")
    items = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(*[held[k] for k in PAYLOAD_KEYS]))
    rows = raw.where(~folder.startswith(".")).select(folder.alias("paper_id"), F.posexplode(items).alias("item_index", "item"))
    return rows.select("paper_id", "item_index", "item.*").withColumn("text", F.coalesce("text", "content")).withColumn("page_idx", F.coalesce("page_idx", "page_no", "page"))


#: names of files that may hold a paper's items, the likelier first
PREFERRED = ["%_content_list.json", "%content_list%.json"]


def one_list_per_paper(files: DataFrame) -> DataFrame:
    """Of the files (file) of each paper's folder the one with the preferred name, then the first by name."""
    name = F.element_at(F.split("file", "/"), -1)
    turn = F.when(name.like(PREFERRED[0].replace("_", "\\_")), 0).when(name.like(PREFERRED[1].replace("_", "\\_")), 1).otherwise(2)
    ranked = files.select("file", F.expr("regexp_replace(file, '/[^/]*$', '')").alias("folder"), turn.alias("turn")).where(F.col("turn") < 2)
    return ranked.groupBy("folder").agg(F.min(F.struct("turn", "file")).alias("b")).select("folder", F.col("b.file").alias("file"))


def manifest_paths(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, file) of papers whose manifest (folder, path) names its list: as it stands, else by the longest tail of the path that a file (file) below any ancestor has."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("tail"), i.alias("i")))
    wanted = manifests.select("folder", F.explode(tails).alias("t")).select("folder", "t.tail", "t.i").where(F.col("tail") != "")
    names = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "/"))
    known = files.select("file", F.explode(ends).alias("tail"))
    near = F.length(F.regexp_extract(F.concat_ws("\n", "folder", "file"), r"^([^\n]*)[^\n]*\n\1", 1))
    hits = wanted.join(known, "tail").withColumn("near", near)
    return hits.groupBy("folder").agg(F.min(F.struct("i", (-F.col("near")).alias("n"), "file")).alias("b")).select("folder", F.col("b.file").alias("file"))


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    """(paper_id, item_index, block_id, page_idx, text, img_path) of papers that have only paragraphs.jsonl and images.jsonl; missing places come first."""
    schema = "item_index int, block_id int, page_idx int, text string, img_path string"
    parts = [spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f).json(root).select("*", F.col("_metadata.file_path").alias("file")) for f in ("paragraphs.jsonl", "images.jsonl")]
    rows = parts[0].unionByName(parts[1]).withColumn("paper_id", F.element_at(F.split("file", "/"), -2)).where(~F.col("paper_id").startswith("."))
    return rows.drop("file").orderBy("paper_id", F.col("item_index").asc_nulls_first(), F.col("block_id").asc_nulls_first(), F.col("page_idx").asc_nulls_first())


def flat_text(c: Column, kind: T.DataType) -> Column:
    """All strings inside a value of any nesting, a line for each, without NUL."""
    if isinstance(kind, T.StringType):
        return F.replace(c, F.lit("\x00"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: flat_text(x, kind.elementType))
        return F.array_join(F.filter(inner, lambda t: t.isNotNull() & (t != "")), "\n")
    if isinstance(kind, T.StructType):
        return F.array_join(F.filter(F.array(*[flat_text(c[f.name], f.dataType) for f in kind.fields]), lambda t: t.isNotNull() & (t != "")), "\n")
    if isinstance(kind, T.MapType):
        return flat_text(F.map_values(c), T.ArrayType(kind.valueType))
    return c.cast("string")


def relative_paths(df: DataFrame, root: str) -> DataFrame:
    """`df` with every path below `root` in its text columns written from there, so that the tables can be moved."""
    base = re.escape(root.rstrip("/"))
    return df.select(*[F.regexp_replace(c, f"(?:file:(?://)?)?{base}/", "").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def without_local_paths(c: Column, places: dict[str, str]) -> Column:
    """A log's text with local paths (longest first, also with backslashes) replaced by their labels."""
    for path in sorted(places, key=len, reverse=True):
        for form in (path, path.replace("/", "\\"), path.replace("/", "\\\\")):
            c = F.replace(c, F.lit(form), F.lit(places[path]))
    return c


def _fields(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema; strict reading fails on a broken line, lenient reading leaves it out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, split by type so that a query of one type reads only its files."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def caption(df_columns: list[str]) -> Column:
    """The first caption list that is not empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in df_columns], F.array().cast("array<string>"))


def resolved_path(raw: str | Column, root: str | Column) -> Column:
    """An absolute path as it is, a relative one below the paper's folder."""
    c = F.col(raw) if isinstance(raw, str) else raw
    base = F.lit(root) if isinstance(root, str) else root
    return F.when(c.startswith("/"), c).when(F.length(F.trim(c)) > 0, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(c, r"^\./", "")))


def plain_table(c: str | Column) -> Column:
    """A table's HTML as text."""
    column = F.col(c) if isinstance(c, str) else c
    return normalize_text(F.regexp_replace(F.regexp_replace(column, "<[^>]+>", " "), r"\s+", " "))
