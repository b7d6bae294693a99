"""Several values packed in one field: a quote-aware finite-state tokenizer.

The scanner walks a field once, tracking quoting, escapes and nesting depth, and
emits the text between delimiters that lie outside quotes and brackets. Strong
delimiters always separate. A comma also stands inside an inverted name
("Last, First"), and "and" inside a group's name, so these two are resolved by
the shape of their neighbours after the scan.

Defined cases: null, empty and blank fields give no rows; empty places and
"et al." are no values and take no position; a field without delimiters is one
value; an unclosed quote runs to the end of the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG = frozenset(";；|\n\r\t·•、/")
CLOSERS = {'"': '"', "“": "”", "„": "”", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
GROUP_HEAD = re.compile(
    r"\b(group|team|consortium|committee|society|association|collaboration|network|initiative|project|council|board|"
    r"laborator(?:y|ies)|university|institute|alliance|collective|panel|workshop|task force|investigators|study)\b",
    re.IGNORECASE,
)
_ET_AL = re.compile(r"[\s,;]*\b(?:et\.?\s+al\b\.?|and\s+others\b\.?|u\.\s?a\.)\s*$", re.IGNORECASE)
_INITIALS = re.compile(r"(?:[^\W\d_]\.[\s-]*)+|[^\W\d_a-z]{1,3}(?:-[^\W\d_a-z])?", re.UNICODE)
_LAST_DOTTED = re.compile(r"\s(?:[^\W\d_]\.[\s-]?)+$")
_AND = re.compile(r"\s+and\s+|\s*&\s*", re.IGNORECASE)


def scan(text: str) -> Iterator[tuple[str, bool, str]]:
    """(piece, quoted, delimiter after it) for each place between delimiters outside quotes.

    A quote opens only where a value begins. Delimiters are the strong ones and ",".
    """
    out: list[str] = []
    quoted, closer, depth, i, n = False, "", [], 0, len(text)
    while i < n:
        ch = text[i]
        if closer:
            if ch == "\\" and i + 1 < n and text[i + 1] in (closer, "\\"):
                out.append(text[i + 1])
                i += 1
            elif ch == closer and i + 1 < n and text[i + 1] == closer:
                out.append(ch)
                i += 1
            elif ch == closer:
                closer = ""
            else:
                out.append(ch)
        elif ch in CLOSERS and not "".join(out).strip():
            out, quoted, closer = [], True, CLOSERS[ch]
        elif depth:
            depth.pop() if ch == depth[-1] else depth.append(BRACKETS[ch]) if ch in BRACKETS else None
            out.append(ch)
        elif ch in BRACKETS and BRACKETS[ch] in text[i:]:
            depth.append(BRACKETS[ch])
            out.append(ch)
        elif ch == "," or ch in STRONG:
            yield "".join(out).strip(), quoted, ch
            out, quoted = [], False
        elif ch == "\\" and i + 1 < n:
            out.append(text[i + 1])
            i += 1
        else:
            out.append(ch)
        i += 1
    yield "".join(out).strip(), quoted, ""


def _given_only(part: str) -> bool:
    """Initials, or given names that end in dotted initials."""
    return bool(_INITIALS.fullmatch(part)) or bool(_LAST_DOTTED.search(" " + part))


def _split_and(part: str) -> list[str]:
    """`part` at "and" and "&", except inside a group's name."""
    if not _AND.search(part):
        return [part]
    if not GROUP_HEAD.search(part):
        return _AND.split(part)
    bits = _AND.split(part)
    # the group takes the last "and" before (or after) its head noun; what stands before that are names
    at = next(i for i, b in enumerate(bits) if GROUP_HEAD.search(b) or i == len(bits) - 1)
    if re.match(r"\s*(?:the\s+)?(?:committee|society|association|group|board|council)\b", bits[at], re.IGNORECASE) and at + 1 < len(bits):
        lo, hi = at, at + 2
    else:
        lo, hi = max(0, at - 1), at + 1
        if lo < at and re.search(r"\b[^\W\d_]\.", bits[lo]):  # initials: a person, not the head of the group's name
            lo = at
    pos = [m.span() for m in _AND.finditer(part)]
    start = pos[lo - 1][1] if lo else 0
    end = pos[hi - 1][0] if hi - 1 < len(pos) else len(part)
    return bits[:lo] + [part[start:end]] + bits[hi:]


def _commas(parts: list[str]) -> list[str]:
    """Names from comma-separated unquoted parts; "Last, First" is one name."""
    parts = [re.sub(r"^(?:and\s+|&\s*)", "", p.strip(), flags=re.IGNORECASE) for p in parts]
    parts = [p for p in parts if p]
    names, i = [], 0
    while i < len(parts):
        part = parts[i]
        halves = _split_and(part)
        names += halves[:-1]
        last = halves[-1]
        nxt = parts[i + 1] if i + 1 < len(parts) else None
        if nxt is not None and not GROUP_HEAD.search(last) and not GROUP_HEAD.search(nxt):
            head, *tail = _split_and(nxt)
            words = last.split()
            inverted = not re.search(r"(?:^|\s)[^\W\d_]\.", last) and not (len(words) > 1 and _INITIALS.fullmatch(words[-1]))
            if inverted and (len(words) == 1 or len(head.split()) == 1 or _given_only(head)):
                names.append(f"{last}, {head}")
                if tail:  # "Last, First and Last2, First2": what follows "and" begins the next name
                    parts[i + 1] = " and ".join(tail)
                    i += 1
                else:
                    i += 2
                continue
        names.append(last)
        i += 1
    return names


def split_packed(text: str | None) -> list[str]:
    """The values of one field in their order, by the rules above."""
    if not text or not text.strip():
        return []
    names: list[str] = []
    run: list[tuple[str, bool]] = []

    def flush() -> None:
        if any(q for _, q in run):
            for piece, q in run:
                names.extend([piece] if q else _split_and(re.sub(r"^(?:and\s+|&\s*)", "", piece)))
        else:
            names.extend(_commas([p for p, _ in run]))
        run.clear()

    for piece, quoted, delimiter in scan(_ET_AL.sub("", text)):
        if not quoted:
            piece = _ET_AL.sub("", piece).strip()
            if re.fullmatch(r"et\.?\s+al\.?", piece, re.IGNORECASE):
                piece = ""
        if piece:
            run.append((piece, quoted))
        if delimiter != ",":
            flush()
    return [n for n in (x.strip() for x in names) if n and not re.fullmatch(r"et\.?\s+al\.?", n, re.IGNORECASE)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_values(field: pd.Series) -> pd.Series:
    """Arrow UDF over `split_packed`."""
    return field.map(split_packed)


def explode_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, field, pos, val) per value of each of `fields`; pos counts from 1.

    Rows with a null key are dropped, repeated rows of a key count once. Extra
    columns of `df` are ignored, whatever their names.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    rows = (
        df.select(F.col(key).alias("_key"), F.explode(pairs).alias("_p"))
        .select("_key", "_p.field", "_p.text")
        .where(F.col("_key").isNotNull() & (F.length(F.trim("text")) > 0))
        .dropDuplicates(["_key", "field", "text"])
    )
    return rows.select(
        F.col("_key").alias(key), "field", F.posexplode(packed_values("text")).alias("_i", "val")
    ).select(key, "field", (F.col("_i") + 1).cast("int").alias("pos"), "val")


def nonblank(column: str | Column) -> Column:
    """True where the text holds something besides blanks."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (F.length(F.trim(c)) > 0)
