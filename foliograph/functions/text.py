"""Text functions as columns; all of them run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that similarity tokens leave out
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to was were with".split()
#: fixed values: lines that carry no content
LOW_SIGNAL = [
    r"^\s*https?://",
    r"\bdoi\.org\b",
    r"^\s*citation\s*:",
    r"^\s*editor\s*:",
    r"^\s*copyright\s*:",
    r"^\s*academic editor\s*:",
    r"^\s*(received|revised|accepted|published)\s*:",
    r"^\s*funding\s*:",
    r"^\s*competing interests\s*:",
    r"^\s*(\* )?e-?mail\s*:",
    r"^\s*correspondence\s*:",
    r"^\s*o\s+check\s+for\s+updates\s*$",
]
#: fixed values: words of a section's title, in the order in which they decide its group
SECTION_GROUPS = [
    ("abstract", ["abstract"]),
    ("introduction", ["introduction", "background"]),
    ("methods", ["method", "materials", "patients", "cohort", "study design"]),
    ("results", ["result", "finding"]),
    ("discussion", ["discussion"]),
    ("conclusion", ["conclusion", "summary", "final remarks"]),
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: str | Column) -> Column:
    """LF line ends, single blanks, at most one empty line, trimmed. Null stays null."""
    lf = F.regexp_replace(F.regexp_replace(_col(c), "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(lf, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def normalize_spaces(c: str | Column) -> Column:
    """All white space collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def lookup_text(c: str | Column) -> Column:
    """Lower case with collapsed white space."""
    return normalize_spaces(F.lower(_col(c)))


def compact_text(c: str | Column) -> Column:
    """Lookup form with letters a-z, digits and CJK ideographs only."""
    return F.regexp_replace(lookup_text(c), "[^a-z0-9一-鿿]+", "")


def strip_accents(c: str | Column) -> Column:
    """Latin letters without their marks, by a table made from the decompositions of U+00C0 to U+024F and U+1E00 to U+1EFF."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return F.translate(_col(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def entity_key(c: str | Column) -> Column:
    """Accent-free lower case, everything else as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: fixed values: words and numbers of titles, and the units of the token estimate
TOKEN, ESTIMATE_UNIT = r"([A-Za-z]+(?:[-'][A-Za-z0-9]+)*|\d+(?:\.\d+)?)", r"[一-鿿]|[A-Za-z0-9_]+|[^\s]"


def similarity_tokens(c: str | Column) -> Column:
    """Words and numbers in lower case without stop words, integers and tokens under 3 characters."""
    words = F.regexp_extract_all(_col(c), F.lit(TOKEN), 1)
    return F.filter(
        F.transform(words, F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\d+$")
    )


def title_key(c: str | Column, size: int = 12) -> Column:
    """The first `size` similarity tokens joined by hyphens."""
    return F.array_join(F.slice(similarity_tokens(c), 1, size), "-")


def is_low_signal(c: str | Column) -> Column:
    """Null, empty, single-character and boilerplate lines."""
    text = normalize_text(c)
    return F.coalesce((F.length(text) <= 1) | text.rlike("(?i)" + "|".join(f"(?:{p})" for p in LOW_SIGNAL)), F.lit(True))


def section_group(c: str | Column) -> Column:
    """The group of a section's title."""
    title = F.lower(normalize_text(c))
    out = F.when(title == "front matter", "front_matter")
    for group, words in SECTION_GROUPS:
        out = out.when(title.rlike("|".join(words)), group)
    return out.otherwise("other")


def preview(c: str | Column, size: int) -> Column:
    """At most `size` characters; what is cut ends in an ellipsis of three dots."""
    text = normalize_spaces(c)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("...")))


#: the same with the blanks of every script, as Python tells them
ANY_ESTIMATE_UNIT = r"[一-鿿]|[A-Za-z0-9_]+|[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def token_estimate(c: str | Column, unit: str = ESTIMATE_UNIT) -> Column:
    """0.9 tokens for each ideograph, word or other sign, rounded up."""
    return F.ceil(F.regexp_count(_col(c), F.lit(unit)) * F.lit(0.9)).cast("bigint")


def year_text(c: str | Column) -> Column:
    """The first year of 19xx or 20xx, empty if there is none."""
    return F.coalesce(F.regexp_extract(_col(c), r"((?:19|20)\d{2})", 1), F.lit(""))


def lookup_variants(c: str | Column) -> Column:
    """Lookup and compact forms of a text with its joining signs read as blanks or words."""
    raw = _col(c)
    forms = [
        raw,
        F.replace(raw, F.lit("-"), F.lit(" ")),
        F.regexp_replace(raw, "[–—]", " "),
        F.replace(raw, F.lit("/"), F.lit(" ")),
        F.replace(raw, F.lit("&"), F.lit(" and ")),
        F.regexp_replace(raw, "[-–—/&]+", " "),
    ]
    both = F.flatten(F.array(*[F.array(lookup_text(f), compact_text(f)) for f in forms]))
    return F.filter(F.array_distinct(both), lambda x: x != "")


def overlap_recall(expected: Column, actual: Column) -> Column:
    """Share of the distinct expected elements that are there; 0 if none are expected."""
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, F.size(F.array_intersect(expected, actual)) / n).otherwise(0.0)


def overlap_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the two recalls: twice the shared over the sum of the sizes."""
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(n > 0, 2 * F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def reference_label(c: str | Column) -> Column:
    """Figure or table label at the start of a caption: "figure 3", "table 2"; empty if there is none."""
    label = F.lower(F.regexp_extract(_col(c), r"(?i)^\s*((?:figure|fig\.?|table|tab\.?|chart)\s*\.?\s*\d+[A-Za-z]?)\b", 1))
    label = normalize_spaces(F.regexp_replace(label, r"\.", " "))
    return F.regexp_replace(F.regexp_replace(label, "^(?:fig|chart) ", "figure "), "^tab ", "table ")


def query_compact(c: str | Column) -> Column:
    """Lower case with letters a-z, digits and CJK ideographs only; white space is not normalised first."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9一-鿿]+", "")


def resolution_text(c: str | Column) -> Column:
    """Accent-free lower case, everything else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(normalize_text(c))), "[^a-z0-9]+", " "))


def compact_alias(c: str | Column) -> Column:
    """Accent-free lower case letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(normalize_text(c))), "[^a-z0-9]+", "")


def person_form(c: str | Column) -> Column:
    """Accent-free lower case words of a name; hyphens stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(normalize_text(c))), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def author_key(c: str | Column) -> Column:
    """Key of an author by the words of the name."""
    return entity_key(person_form(c))


def first_author(c: str | Column) -> Column:
    """First word of an author text, or its last one if the first is a lone letter; empty without letters."""
    words = F.regexp_extract_all(F.lower(strip_accents(F.coalesce(_col(c), F.lit("")))), F.lit("([a-z]+)"), 1)
    return F.when(F.size(words) == 0, "").when((F.length(words[0]) == 1) & (F.size(words) > 1), F.element_at(words, -1)).otherwise(words[0])


def letter_runs(c: str | Column) -> Column:
    """Number of runs of letters of any script."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"[\p{L}]+")).cast("bigint")


def alpha_tokens(c: str | Column) -> Column:
    """Number of tokens between white space that hold a Latin letter."""
    return F.size(F.filter(F.split(normalize_text(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda w: w.rlike("[A-Za-z]"))).cast("bigint")


def trim_to(c: str | Column, size: int) -> Column:
    """At most `size` characters of collapsed text; what is cut ends in one ellipsis sign."""
    text = normalize_spaces(F.coalesce(_col(c), F.lit("")))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…")))


def join_unique(*parts: str | Column) -> Column:
    """Normalised parts, each once in their order, one to a line; null and empty parts are left out."""
    texts = F.array(*[normalize_text(p) for p in parts])
    return F.array_join(F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != ""))), "\n")


def distinct_in_order(c: str | Column) -> Column:
    """Elements of an array, each once, where it stands first."""
    return F.array_distinct(_col(c))


def word_set(c: str | Column) -> Column:
    """Distinct words of a-z and digits of at least two characters, of the lookup form."""
    return F.array_distinct(F.filter(F.regexp_extract_all(lookup_text(c), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 2))


def whole_number(c: str | Column) -> Column:
    """The integer that a text holds, null if it holds none."""
    return _col(c).try_cast("int")


def box(c: str | Column) -> Column:
    """A bounding box of exactly four numbers, else null."""
    b = _col(c)
    return F.when((F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull() | F.isnan(x)), b)


def page_label(first: str | Column, last: str | Column) -> Column:
    """Zero-based pages as a one-based label: p.1, p.6-7, or empty."""
    a, b = _col(first) + 1, _col(last) + 1
    one = F.concat(F.lit("p."), F.coalesce(a, b).cast("string"))
    return F.when(a.isNull() & b.isNull(), "").when(a.isNull() | b.isNull() | (a == b), one).otherwise(F.concat(one, F.lit("-"), b.cast("string")))
