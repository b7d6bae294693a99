"""Repairing text from scanned pages.

Lines first: every line is judged as furniture (a running header, a page number)
or text, and every pair of a line that ends in a hyphen-like mark and the next line
of text as a broken word or not, both by boosted trees trained on the sample
paragraphs with their correct readings; what is known of the paper (its title, the
venues) marks further headers. Words next: the words of unscanned texts are the
lexicon: the common ones are sent to all tasks, the others are joined to the records
that look them up. Words of scanned texts outside it meet the lexicon in an inverted join on
character q-grams (the rarest of each word, by the lexicon's counts), and boosted
trees rank the candidates by what was replaced by what, how often the samples show
that, and how common the candidate is. Corrections are made per distinct word.

Defined cases: null, empty and blank texts have no defects and stay as they are;
a text without line breaks has no broken words but may have misread ones; repeated
rows of a record count once; without samples nothing is repaired but what the
paper's own title and the page patterns show.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm.boosting import Boosted
from foliograph.llm.names import fold
from foliograph.sources.store import settle

HYPHENS = "-‐‑¬­–"
_PAGE = re.compile(r"(?:[-–—]\s*\d{1,4}\s*[-–—]|(?:p|pp|page|pg)\.?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}|[ivxl]{1,6})", re.IGNORECASE)
_PAGE_AT = re.compile(rf"^(?:(?P<a>{_PAGE.pattern})(?:\s{{2,}}|$)(?P<rest>.*)|(?P<rest2>.*?\S)\s{{2,}}(?P<b>{_PAGE.pattern}))$", re.IGNORECASE)
_GAP = re.compile(r"\s\s")
_EDGE = ".,;:?()[]{}\"'“”‘’…|/·•&，。；：、（）"
#: fixed values: confusions known from character recognition at large, counted as if the samples showed them
KNOWN_CONFUSIONS = [
    ("ii", "u"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ri", "n"), ("in", "m"), ("m", "in"), ("li", "h"),
    ("c", "e"), ("b", "h"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("3", "e"), ("$", "s"), ("|", "l"),
    ("€", "e"), ("†", "t"), ("@", "a"), ("!", "i"), ("!", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), (" ", ""),
]
_INITIALS = re.compile(r"^(?:[^\W\d_]\.[\s-]?)+\s?[^\W\d_][\w'’-]+(?:\s[\w'’-]+)?:\s")
_ETAL = re.compile(r"\bet\.? al\.?$", re.IGNORECASE)


def page_part(line: str) -> tuple[str, str]:
    """(page number, rest) of a line; either may be empty."""
    line = line.strip()
    if len(line) > 24 and not _GAP.search(line):  # a number with text beside it stands behind a gap
        return "", line
    m = _PAGE_AT.match(line)
    if not m:
        return "", line
    return m["a"] or m["b"], (m["rest"] if m["a"] else m["rest2"]).strip()


def _only_page(line: str) -> bool:
    return len(line) < 24 and bool(_PAGE.fullmatch(line.strip()))


def _flat(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", fold(text)).strip()


def header_of_paper(line: str, title: str | None, venues: frozenset[str]) -> bool:
    """A line that repeats the beginning of the paper's title, alone or after an author, or names a venue."""
    flat = _flat(line)
    if not flat:
        return False
    if flat in venues:
        return True
    head = _flat(title or "")
    if not head:
        return False
    if m := _INITIALS.match(line):
        rest = _flat(line[m.end() :])
        return bool(rest) and (head + " ").startswith(rest + " ")
    return len(flat.split()) > 2 and (head + " ").startswith(flat + " ") or len(flat) > 14 and (head + " ").startswith(flat + " ")


def line_features(line: str, before: str, after: str) -> list[float]:
    """What a line looks like by itself and between its neighbours ("" where there is none)."""
    page, rest = page_part(line)
    words = rest.split()
    letters = [c for c in rest if c.isalpha()]
    etal = bool(re.search(r"\bet\.? al\.?$", rest, re.IGNORECASE))
    return [
        float(bool(page)),
        float(etal and len(words) <= 5),
        len(words),
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        len(line.strip()) / max(1, len(before.strip()) or len(after.strip()) or 60),
        float(bool(before) and before.rstrip()[-1:] not in ".!?:"),
        float(bool(after) and after.lstrip()[:1].islower()),
        float(rest[-1:] in ".!?" and not etal),
        float(rest[:1].isupper()),
        float(bool(re.search(r"\d", rest))),
    ]


def hyphen_features(left: str, mark: str, right: str, lexicon) -> list[float]:
    """What a word cut at a line's end looks like against the lexicon."""
    joined, compound = f"{left}{right}".lower(), f"{left}-{right}".lower()
    return [
        float(mark == "-"),
        float(joined in lexicon),
        float(compound in lexicon),
        float(left.lower() in lexicon),
        float(right.lower() in lexicon),
        float(right[:1].islower()),
        float(left[-1:].isalpha()),
        min(len(left), 8),
        min(len(right), 8),
    ]


def middle(a: str, b: str) -> tuple[str, str]:
    """What is left of two words without their common beginning and end."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


@lru_cache(maxsize=500_000)
def strip_word(word: str) -> str:
    """A word without the punctuation around it, in lower case."""
    return word.strip(_EDGE).rstrip("!").strip(_EDGE).lower()


@dataclass
class Models:
    """Everything learnt from the samples."""

    furniture: Boosted = field(default_factory=Boosted)
    hyphen: Boosted = field(default_factory=Boosted)
    ranker: Boosted = field(default_factory=Boosted)
    confusions: Counter = field(default_factory=Counter)

    def rank(self, token: str, candidates: list[tuple[str, int]], own: tuple[str, str] | None = None) -> list[list[float]]:
        """Features of each candidate for a token; `own` is a pair whose own occurrence is not to count."""
        out = []
        for word, count in candidates:
            m = middle(token, word)
            seen = self.confusions[m] - (own == m)
            odd = bool(re.search(r"[^\W\d_]", token)) and bool(re.search(r"[\d†@!|$€¢£‡]", m[0]))
            out.append(
                [
                    np.log1p(max(0, seen)),
                    len(m[0]),
                    len(m[1]),
                    np.log1p(count),
                    len(word),
                    float(odd),
                    float(m == (" ", "")),
                    len(m[0]) / max(1, len(token)),
                    float(token.startswith(m[0]) and bool(m[0])),
                ]
            )
        return out


def _pieces(raw: str) -> list[str]:
    return [x for x in re.split(r"\r?\n", raw) if x.strip()]


def learn(samples: list[tuple[str, str]]) -> Models:
    """The models from (raw text, correct text) pairs."""
    models = Models()
    lexicon = Counter(strip_word(w) for _, clean in samples if clean for w in clean.split())
    xs, ys, hx, hy = [], [], [], []
    words: list[tuple[str, str]] = []
    for raw, clean in samples:
        if not raw or not clean:
            continue
        known = {strip_word(w) for w in clean.split()}
        lines = _pieces(raw)
        text = []
        for i, line in enumerate(lines):
            tokens = [strip_word(w) for w in page_part(line)[1].split()]
            odd = not tokens or sum(t in known for t in tokens) < 0.4 * len(tokens) and len(tokens) < 9
            before, after = (lines[i - 1] if i else ""), (lines[i + 1] if i + 1 < len(lines) else "")
            xs.append(line_features(line, before, after))
            ys.append(odd)
            if odd:
                xs.append(line_features(line, "", ""))
                ys.append(True)
            else:
                text.append(line)
        xs.append(line_features(clean, "", ""))
        ys.append(False)
        for one, two in zip(text, text[1:]):
            end, begin = one.rstrip(), two.lstrip()
            if end[-1:] in HYPHENS and end[-2:-1].isalpha():
                left, right = end[:-1].split()[-1].strip(_EDGE), begin.split()[0].strip(_EDGE)
                whole = f"{left}{right}".lower()
                rest = lexicon.copy()
                rest.subtract([whole, f"{left}-{right}".lower()])
                hx.append(hyphen_features(left, end[-1], right, {w for w in (left.lower(), right.lower(), whole, f"{left}-{right}".lower()) if rest[w] > 0 or w in (left.lower(), right.lower()) and lexicon[w] > 0}))
                hy.append(whole in known or end[-1] != "-")
        joined = re.sub(rf"(?<=[^\W\d_])[{HYPHENS}]\s*\n\s*", "", "\n".join(text))
        a, b = joined.split(), clean.split()
        for op, i, j, k, l in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op == "replace" and j - i == l - k:
                words += [(strip_word(x), strip_word(y)) for x, y in zip(a[i:j], b[k:l])]
            elif op == "replace" and j - i == 2 and l - k == 1 and a[i] + a[i + 1] == b[k]:
                words.append((f"{strip_word(a[i])} {strip_word(a[i + 1])}", strip_word(b[k])))
    words = [(x, y) for x, y in words if x and y and x != y and len(middle(x, y)[0]) <= 3 and len(middle(x, y)[1]) <= 3]
    models.confusions = Counter(middle(x, y) for x, y in words)
    for pair in KNOWN_CONFUSIONS:
        models.confusions[pair] = max(models.confusions[pair], 3)
    vocabulary = list(lexicon)
    rx, ry = [], []
    for raw, right in words:
        near = [w for w in vocabulary if w != right and abs(len(w) - len(raw)) < 2 and w[:1] == raw[:1] and len(middle(raw, w)[0]) < 4][:6]
        rx += models.rank(raw, [(right, max(1, lexicon[right]))], middle(raw, right)) + models.rank(raw, [(w, lexicon[w]) for w in near])
        ry += [True] + [False] * len(near)
    for word in vocabulary:  # right words, and right words with a typing slip, are not to be changed
        near = [w for w in vocabulary if w != word and abs(len(w) - len(word)) < 2 and w[:1] == word[:1] and len(middle(word, w)[0]) < 4][:3]
        rx += models.rank(word, [(w, lexicon[w]) for w in near], None)
        ry += [False] * len(near)
        if len(word) > 4 and word.isalpha():
            at = len(word) // 2
            for slip in (word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :]):
                if slip != word:
                    rx += models.rank(slip, [(word, lexicon[word])], middle(slip, word))
                    ry.append(False)
    models.furniture.fit(np.array(xs or [[0.0] * 10]), np.array(ys or [0]))
    models.hyphen.fit(np.array(hx or [[0.0] * 9]), np.array(hy or [0]))
    models.ranker.fit(np.array(rx or [[0.0] * 9]), np.array(ry or [0]))
    return models


@lru_cache(maxsize=8)
def _venue_heads(venues: frozenset[str]) -> frozenset[str]:
    return frozenset(v.split()[0] for v in venues if v)


@lru_cache(maxsize=100_000)
def _head(word: str) -> str:
    return (_flat(word).split() or [""])[0]


@dataclass
class Reading:
    """A text with its furniture and broken words told apart."""

    lines: list[str]
    defects: set[str]
    text: str


def _text_lines(text: str, title: str | None, venues: frozenset[str], models: Models) -> tuple[list[str], set[str]]:
    """(lines without furniture, defects of furniture)."""
    raw = re.split(r"\r?\n", text)
    filled = [i for i, x in enumerate(raw) if x.strip()]
    defects: set[str] = set()
    drop: set[int] = set()
    title_head = _head(title.split(None, 1)[0]) if title and title.strip() else ""
    heads = _venue_heads(venues)
    # a short look tells most lines apart from anything that could be furniture
    pages: dict[int, tuple[str, str]] = {}
    named: set[int] = set()
    feats: dict[int, list[float]] = {}
    for k, i in enumerate(filled):
        line = raw[i].strip()
        page, rest = page_part(line)
        etal = _ETAL.search(rest)
        head = _head(rest.split(None, 1)[0]) if rest else ""
        if rest and (head == title_head or head in heads or _INITIALS.match(rest)) and header_of_paper(rest, title, venues):
            named.add(i)
        if page or etal:
            before = next((raw[j] for j in reversed(filled[:k]) if not _only_page(raw[j])), "")
            after = next((raw[j] for j in filled[k + 1 :] if not _only_page(raw[j])), "")
            feats[i] = line_features(line, before, after)
        if page or etal or i in named:
            pages[i] = (page, rest)
    odd = dict(zip(feats, models.furniture.predict(np.array(list(feats.values()))) if feats else []))
    for i, (page, rest) in pages.items():
        header = i in named or bool(rest) and feats.get(i, [0, 0])[1] > 0 and odd.get(i, 0) >= 0.5
        if header or page and not rest and odd.get(i, 0) >= 0.5:
            drop.add(i)
            defects |= ({"header"} if header else set()) | ({"page_no"} if page else set())
    return [raw[i] for i in range(len(raw)) if i not in drop], defects


def _join_lines(kept: list[str], mark_for: Callable[[str, str, str, int], str]) -> list[str]:
    """Lines with cut words put together by mark_for(left, mark, right, place in a word of several cuts)."""
    out: list[str] = []
    turn = 0
    for line in kept:
        prior = out[-1].rstrip() if out else ""
        begin = line.lstrip()
        if prior and begin and prior[-1] in HYPHENS and prior[-2:-1].isalpha() and begin[0].isalpha():
            left, right = prior[:-1].split()[-1].strip(_EDGE), begin.split()[0].strip(_EDGE)
            first, _, later = begin.partition(" ")
            out[-1] = prior[:-1] + mark_for(left, prior[-1], right, turn) + first
            turn += 1
            if later:
                out.append(later)
                turn = 0
        else:
            out.append(line)
            turn = 0
    return out


def read_lines(text: str, title: str | None, venues: frozenset[str], lexicon, models: Models) -> Reading:
    """Removes furniture and joins broken words; paragraphs keep their blank lines."""
    kept, defects = _text_lines(text, title, venues, models)

    def mark_for(left: str, mark: str, right: str, turn: int) -> str:
        broken = models.hyphen.predict(np.array([hyphen_features(left, mark, right, lexicon)]))[0] >= 0.5
        if broken:
            defects.add("hyphen")
        compound = f"{left}-{right}".lower() in lexicon and f"{left}{right}".lower() not in lexicon
        return "-" if compound or not broken else ""

    out = _join_lines(kept, mark_for)
    return Reading(out, defects, "\n".join(out))


class _Known:
    """The words all tasks have and those a record has been told of."""

    def __init__(self, common, own) -> None:
        self.common, self.own = common, frozenset(own if own is not None else ())

    def __contains__(self, word: str) -> bool:
        return word in self.common or word in self.own


class _Asking:
    """Stands for a lexicon and notes the words that only the full one can tell."""

    def __init__(self, common) -> None:
        self.common, self.asked = common, set()

    def __contains__(self, word: str) -> bool:
        if word in self.common:
            return True
        if _countable(word):
            self.asked.add(word)
        return False


def lookups(text: str, title: str | None, venues: frozenset[str], common, models: Models) -> set[str]:
    """The words outside `common` that reading the text and finding its suspects may look up, however cut words are joined."""
    kept, _ = _text_lines(text, title, venues, models)
    asking = _Asking(common)
    longest = 0
    pattern = 0
    while pattern < 2**longest or not pattern:

        def mark_for(left: str, mark: str, right: str, turn: int) -> str:
            nonlocal longest
            longest = max(longest, turn + 1)
            hyphen_features(left, mark, right, asking)
            return "-" if pattern >> turn & 1 else ""

        suspects("\n".join(_join_lines(kept, mark_for)), asking)
        pattern += 1
    return asking.asked


def suspects(text: str, lexicon) -> set[str]:
    """Words outside the lexicon, and neighbours that are a word of it together."""
    found: set[str] = set()
    raw = re.split(r"[\s;|；/]+", text)
    words = [strip_word(w) for w in raw]
    ends = [w[-1:] in ".,;:?!)" for w in raw]
    for i, word in enumerate(words):
        if len(word) < 2 or word in lexicon or not re.search(r"[^\W\d_]", word):
            unknown = bool(word) and word not in lexicon and len(word) == 1
        else:
            unknown = True
            if len(word) > 2 or re.search(r"[†@!0-9]", word):
                found.add(word)
        if i and not ends[i - 1] and words[i - 1] and word:
            pair = words[i - 1] + word
            if len(pair) > 3 and (unknown or words[i - 1] not in lexicon) and pair.isalpha() and pair in lexicon:
                found.add(f"{words[i - 1]} {word}")
                found.discard(word)
                found.discard(words[i - 1])
    return found


def qgrams(word: str) -> list[str]:
    """Trigrams of a word with its ends marked, and its first and last letter with its length."""
    bare = word.replace(" ", "")
    text = f"^{bare}$"
    return sorted({text[i : i + 3] for i in range(len(text) - 2)} | {f"{bare[:1]}~{bare[-1:]}{len(bare)}"})


def token_qgrams(word: str) -> list[str]:
    """The q-grams of a word that may be misread: its ends also with the lengths next to its own."""
    bare = word.replace(" ", "")
    return sorted({*qgrams(word), *(f"{bare[:1]}~{bare[-1:]}{len(bare) + k}" for k in (-1, 1))})


def _countable(word: str) -> bool:
    return len(word) > 1 and not word[0].isdigit()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) partial counts, one pass over each batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.iloc[:, 0]:
            counts.update(map(strip_word, re.split(r"[\s;|；/]+", text)))
        rows = [(w, n) for w, n in counts.items() if _countable(w)]
        yield pd.DataFrame(rows, columns=["word", "n"])


def build_lexicon(texts: DataFrame, share: float = 2e-6, least: int = 3) -> tuple[DataFrame, int]:
    """((word, n) of the words of `texts` that stand there `least` times, count from which a word is common).

    Common words hold more than `share` of all words: at most 1 / share rows at any size.
    """
    counts = settle(texts.where(F.length("text") > 0).select("text").mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return settle(counts.where(F.col("n") >= least)), max(least, int(total * share) + 1)


RECORD = ["src_table", "rec_id"]


def _ask(shared):
    """(src_table, rec_id, word): what each record has to be told of the full lexicon."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, common, venues = shared.value
        for batch in batches:
            rows = [(src, rec, w) for src, rec, text, title in batch.itertuples(index=False) for w in lookups(text, title, venues, common, models)]
            yield pd.DataFrame(rows, columns=[*RECORD, "word"])

    return run


def _told(scanned: DataFrame, known: DataFrame | None) -> DataFrame:
    """`scanned` with `known`, the words of the full lexicon that a record looks up beside the common ones."""
    none = F.lit(None).cast("array<string>").alias("known")
    return scanned.select("*", none) if known is None else scanned.join(known, RECORD, "left")


FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("src_table", "rec_id", "defect", "token")])


def _first_pass(shared):
    """FOUND rows: defects of lines, and suspect words with the defect still open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, common, venues = shared.value
        for batch in batches:
            rows = []
            for src, rec, text, title, known in batch.itertuples(index=False):
                lexicon = _Known(common, known)
                reading = read_lines(text, title, venues, lexicon, models)
                rows += [(src, rec, d, None) for d in reading.defects]
                rows += [(src, rec, None, t) for t in suspects(reading.text, lexicon)]
            yield pd.DataFrame(rows, columns=FOUND.names)

    return run


CORRECTIONS = T.StructType([T.StructField("token", T.StringType()), T.StructField("word", T.StringType()), T.StructField("p", T.DoubleType())])


def _rank_pairs(shared):
    """CORRECTIONS from candidate pairs (token, word, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value[0]
        for batch in batches:
            pairs, feats = [], []
            for token, word, n in batch.itertuples(index=False):
                m = middle(token, word)
                if len(m[0]) <= 3 and len(m[1]) <= 3 and token != word:
                    pairs.append((token, word))
                    feats += models.rank(token, [(word, n)])
            p = models.ranker.predict(np.array(feats)) if feats else []
            yield pd.DataFrame([(t, w, float(q)) for (t, w), q in zip(pairs, p) if q >= 0.5], columns=CORRECTIONS.names)

    return run


def _alike(pairs: DataFrame) -> DataFrame:
    """`pairs` (token, word) whose lengths are close and that may differ in a middle of 3 letters at most (see `middle`), which takes 3 edits at most.

    Pairs of words with a q-gram in common grow as the square of the words; those that
    are alike do not, so only they are shuffled.
    """
    near = F.abs(F.length(F.replace("token", F.lit(" "), F.lit(""))) - F.length("word")) <= 1
    return pairs.where(near & (F.levenshtein("token", "word", 3) >= 0))


def corrections(tokens: DataFrame, lexicon: DataFrame, shared, rarest: int = 7) -> DataFrame:
    """CORRECTIONS, the best per token of `tokens` (token), from the q-gram join with the lexicon."""
    grams = F.pandas_udf(lambda s: s.map(qgrams), T.ArrayType(T.StringType()))
    own = F.pandas_udf(lambda s: s.map(token_qgrams), T.ArrayType(T.StringType()))
    listed = settle(lexicon.select("word", "n", F.explode(grams("word")).alias("gram")))
    often = listed.groupBy("gram").agg(F.count("*").alias("df"))
    order = W.partitionBy("token").orderBy("df", "gram")
    rare = (
        tokens.select("token", F.explode(own("token")).alias("gram"))
        .join(often, "gram")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rarest)
    )
    pairs = _alike(rare.select("token", "gram").join(listed, "gram")).select("token", "word", "n").distinct()
    ranked = pairs.mapInPandas(_rank_pairs(shared), CORRECTIONS)
    best = ranked.groupBy("token").agg(F.min(F.struct((-F.col("p")).alias("q"), F.col("word"))).alias("b"))
    return best.select("token", F.col("b.word").alias("word"), (-F.col("b.q")).alias("p"))


@dataclass
class Scans:
    """Defects and corrections of a set of scanned texts."""

    found: DataFrame
    corrected: DataFrame
    shared: object
    known: DataFrame | None


def examine(scanned: DataFrame, clean: DataFrame, samples: DataFrame, venues: DataFrame) -> Scans:
    """Reads `scanned` (src_table, rec_id, text, title) against `clean` (text); `samples` (raw_text, clean_text) has a fixed size.

    `venues` (name) is the fixed set of venue names.
    """
    models = learn([(r[0], r[1]) for r in samples.select("raw_text", "clean_text").collect()])
    lexicon, common = build_lexicon(clean)
    words = {r[0]: r[1] for r in lexicon.where(F.col("n") >= common).collect()}
    names = frozenset(_flat(r[0]) for r in venues.where(F.col("name").isNotNull()).select("name").distinct().collect())
    shared = scanned.sparkSession.sparkContext.broadcast((models, words, names))
    filled = scanned.where(F.length(F.trim("text")) > 0).select(*RECORD, "text", "title")
    rarer = lexicon.where(F.col("n") < common).select("word")
    known = None
    if rarer.head(1):  # else the common words are all there are
        asked = filled.mapInPandas(_ask(shared), "src_table string, rec_id string, word string")
        known = settle(asked.join(rarer, "word").groupBy(*RECORD).agg(F.collect_set("word").alias("known")))
    found = settle(_told(filled, known).select(*RECORD, "text", "title", "known").mapInPandas(_first_pass(shared), FOUND))
    tokens = found.where(F.col("token").isNotNull()).select("token").distinct()
    return Scans(found, corrections(tokens, lexicon, shared), shared, known)


def defects(scans: Scans) -> DataFrame:
    """(src_table, rec_id, defect), each once."""
    lines = scans.found.where(F.col("defect").isNotNull()).select("src_table", "rec_id", "defect")
    words = scans.found.where(F.col("token").isNotNull()).join(scans.corrected, "token").select("src_table", "rec_id", F.lit("misread").alias("defect"))
    return lines.unionByName(words).distinct()


def _repair(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, common, venues = shared.value
        for batch in batches:
            rows = []
            for src, rec, text, title, known, fixes in batch.itertuples(index=False):
                text = read_lines(text, title, venues, _Known(common, known), models).text if text else text
                for fix in fixes if fixes is not None else []:
                    pattern = re.compile(rf"(?<![^\W_]){re.escape(fix['token'])}(?![^\W_])".replace(r"\ ", r"\s+"), re.IGNORECASE)
                    text = pattern.sub(lambda m, w=fix["word"]: w.capitalize() if m[0][0].isupper() else w, text)
                text = re.sub(r"\s+", " ", re.sub(r"(?<!\n)\n(?!\s*\n)", " ", text)) if text and "\n\n" not in text else text
                rows.append((src, rec, text))
            yield pd.DataFrame(rows, columns=["src_table", "rec_id", "text"])

    return run


def repair(scanned: DataFrame, scans: Scans) -> DataFrame:
    """(src_table, rec_id, text) with furniture removed, words joined and corrected, lines run on to paragraphs."""
    fixes = (
        scans.found.where(F.col("token").isNotNull())
        .join(scans.corrected, "token")
        .groupBy("src_table", "rec_id")
        .agg(F.sort_array(F.collect_set(F.struct("token", "word"))).alias("fixes"))
    )
    rows = _told(scanned, scans.known).join(fixes, RECORD, "left").select(*RECORD, "text", "title", "known", "fixes")
    return rows.mapInPandas(_repair(scans.shared), "src_table string, rec_id string, text string")
