"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is a tree: sections under headings, nested by the headings' depth (marks or
dotted numbers); paragraphs; lists, nested by indentation; lines; sentences; clauses;
words; characters. Only nodes above the limit are opened; what fits is kept whole, and
sibling subtrees are merged again up to the limit. Pieces of an opened section,
paragraph or list item do not mix with its siblings; below that, the end of an opened
sentence may go on with the next one. The cuts tile the text; each piece then begins
`overlap` characters before its cut, and `limit` counts that overlap.

Defined cases: texts within the limit and null texts give no pieces; a text
without any boundary is cut between characters, never inside a combining
sequence where one can be avoided; lengths are in code points; repeated rows of a
record count once, and a null key is dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: where a child of each level of the tree may begin, from coarse to fine
LEVELS = [
    re.compile(r"\n(?=#{1,6}\s)|\n(?=(?:\d+(?:\.\d+)*\.?\s+)?[^\W\d_][^\n.!?;]{0,80}\n\s*\n)|(?<=\n)(?=(?:-{3,}|\*{3,}|={3,})\s*\n)"),
    re.compile(r"(?<=\n)(?=[ \t]*(?:\r?\n))|\n[ \t\r]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?:\s+|(?<=[。！？])|$)"),
    re.compile(r"[;:,，；：、]\s+|[，；：、]"),
    re.compile(r"\s+"),
]


def _children(text: str, lo: int, hi: int, level: int) -> list[int]:
    """Ends of the children of text[lo:hi] at this level, the last being hi."""
    ends = [m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi]
    return sorted(set(ends)) + [hi]


def _characters(text: str, lo: int, hi: int, limit: int) -> list[int]:
    ends = []
    while hi - lo > limit:
        cut = lo + limit
        while cut > lo + limit // 2 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
            cut -= 1
        ends.append(cut)
        lo = cut
    return ends + [hi]


_DEPTH = re.compile(r"(#{1,6})\s|(\d+(?:\.\d+)*)\.?\s")


def _depth(text: str, at: int) -> int:
    """Depth of the heading that begins at `at`: its marks or the parts of its number, 1 without either."""
    m = _DEPTH.match(text, at)
    return 1 if not m else len(m[1]) if m[1] else m[2].count(".") + 1


def _indent(text: str, at: int) -> int:
    """Blanks at the beginning of the line at `at`; a tab counts four."""
    width = 0
    while at < len(text) and text[at] in " \t":
        width += 4 if text[at] == "\t" else 1
        at += 1
    return width


def _siblings(text: str, lo: int, hi: int, level: int) -> tuple[list[int], bool]:
    """(ends of the children of text[lo:hi] at this level, whether a child may hold further ones of it)."""
    ends = _children(text, lo, hi, level)
    if level not in (0, 2) or len(ends) == 1:
        return ends, False
    rank = _depth if level == 0 else _indent
    depths = [rank(text, e) for e in ends[:-1]]
    first = rank(text, lo) if level == 2 else min(depths)
    top = min([first, *depths])
    outer = [e for e, d in zip(ends, depths) if d <= top]
    return (outer + [hi], True) if outer else (ends, False)


#: headings and lists nested deeper than this are read as one level
DEEPEST = 40


def cuts(text: str, limit: int, lo: int = 0, hi: int | None = None, level: int = 0, nest: int = 0) -> list[int]:
    """Ends of consecutive parts of text[lo:hi], none longer than `limit`."""
    hi = len(text) if hi is None else hi
    if hi - lo <= limit:
        return [hi]
    if level == len(LEVELS):
        return _characters(text, lo, hi, limit)
    ends: list[int] = []
    run: list[int] = []  # ends of siblings that may be merged with one another

    def merge() -> None:
        start = ends[-1] if ends else lo
        for i, end in enumerate(run):
            if i + 1 == len(run) or run[i + 1] - start > limit:
                ends.append(end)
                start = end
        run.clear()

    children, nested = _siblings(text, lo, hi, level)
    at = lo
    for end in children:
        inside = nested and nest < DEEPEST
        parts = cuts(text, limit, at, end, level if inside else level + 1, nest + 1 if inside else 0)  # a node within the limit stays whole
        if level < 3 and len(parts) > 1:
            merge()
            ends += parts
        else:
            run += parts
        at = end
    merge()
    return ends


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; neighbours share `overlap` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends = cuts(text, limit - overlap)
    return [(max(0, start - overlap), end) for start, end in zip([0, *ends], ends)]


def split_oversized(df: DataFrame, *, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(key, piece_no, start, end, piece) for every record whose text exceeds `limit` characters.

    Only oversized texts leave the scan; piece_no counts from 1, start from 0.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("piece", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, n, lo, hi, t[lo:hi])
                for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1])
                for n, (lo, hi) in enumerate(pieces(t, limit, overlap), 1)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    large = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(
        F.col("_key").isNotNull() & (F.length("_text") > limit)
    )
    return large.groupBy("_key").agg(F.max("_text").alias("_text")).mapInPandas(run, schema)
