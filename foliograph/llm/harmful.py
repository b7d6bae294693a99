"""Abusive, hateful or sexual content: a character n-gram linear classifier with
naive Bayes log-count-ratio features.

A document is a bag of units (sentences and lines), because a label says only that
some unit of it is harmful. Units are folded (case, look-alike letters, digits
inside words, stretched letters, numbers), cut into character n-grams, and hashed.
Each n-gram counts by the naive Bayes log-count ratio of its occurrence in harmful
and harmless units; a logistic regression learns the weights over these. Training
alternates: the most harmful unit of each harmful document stands for it in the
next round, and documents that contradict the others by far are taken for
raters' errors. A document's score is that of its most harmful unit.

Training happens on the driver over at most `train_docs` labelled documents, chosen
by the hash of their id; scoring covers every document in one narrow pass.

Defined cases: null, empty and blank texts score 0; a document rated by several
raters counts by their majority, ties are left out; without labels of both kinds
every score is 0; repeated rows of a document give repeated scores.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: letters of other scripts that look like Latin ones, and signs used in place of letters
LOOKALIKES = str.maketrans("аесорхуіјѕһԁкмтвнοαενικρτυ", "aecopxyijshdkmtbhoaevikptu")
LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_WORD = re.compile(r"(?<!\w)(?=[a-z013457@$!]*[a-z])(?=[a-z@$!]*[013457@$!])[a-z013457@$!]{3,}(?![\w])")
_SPACED = re.compile(r"\b(?:[a-z][ .*_-]){3,}[a-z]\b")
#: a unit ends with its sentence or line; a line that goes on in lower case is not ended
_SOFT = re.compile(r"[ \t\r]*\n(?=[^\W\d_A-Z])|(?<=[\w,;])-\n(?=[a-z])")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？])|\n")
SHORTEST, LONGEST = 16, 110
_LEAD = re.compile(r"^(?:[>\-*•\d.\[\] ]|user\d+:|\[ \])+")
BITS = 18


def fold(text: str) -> str:
    """The form in which units are compared."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c) and c not in "​‌‍­")
    if not text.isascii() and re.search("[a-z]", text):
        text = text.translate(LOOKALIKES)
    text = _LEET_WORD.sub(lambda m: m[0].translate(LEET) if not m[0][-1] == "!" or m[0][:-1].strip("abcdefghijklmnopqrstuvwxyz") else m[0], text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text)
    text = re.sub(r"([^\W\d])\1{2,}", r"\1", text)
    return re.sub(r"\s+", " ", re.sub(r"\d+(?:[.,]\d+)*", "0", _LEAD.sub("", text))).strip()


def _windows(unit: str) -> list[str]:
    """A long unit as overlapping windows, so that no harmless neighbour dilutes a short phrase.

    They begin at words, but never more than half a window back, and the last one ends
    with the unit: every character is in a window, also where there are no blanks.
    """
    if len(unit) <= LONGEST:
        return [unit]
    half = LONGEST // 2
    starts = [max(unit.rfind(" ", 0, at) + 1, at - half) for at in range(0, len(unit) - half, half)]
    if starts[-1] + LONGEST < len(unit):
        starts.append(len(unit) - LONGEST)
    return [unit[a : a + LONGEST] for a in dict.fromkeys(max(0, a) for a in starts)]


def units(text: str | None) -> list[str]:
    """Folded units of a text, each once; what is shorter than SHORTEST goes with its neighbour."""
    out: list[str] = []
    short = ""
    for part in _END.split(_SOFT.sub(" ", text or "")):
        unit = fold(part) if part else ""
        if not unit:
            continue
        unit = f"{short} {unit}" if short else unit
        short = unit if len(unit) < SHORTEST else ""
        if not short:
            out += _windows(unit)
    if short:
        out.append(f"{out.pop()} {short}" if out else short)
    return list(dict.fromkeys(out))


def ngram_ids(texts: list[str], lo: int = 1, hi: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of each n-gram of each text."""
    codes = np.frombuffer("".join(f" {t} \0" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 3 for t in texts])
    value = np.zeros(len(codes), np.uint64)
    ok = np.ones(len(codes), bool)
    rows, grams = [], []
    for n in range(1, hi + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        ok = ok[:m] & (codes[n - 1 :] != 0)
        if n >= lo:
            hashed = ((value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            rows.append(owner[:m][ok])
            grams.append(hashed[ok].astype(np.int32))
    return (np.concatenate(rows), np.concatenate(grams)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int32))


@dataclass
class Model:
    """Weights of the hashed n-grams (log-count ratio times learned weight), the bias and the threshold."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.8

    def score_units(self, texts: list[str]) -> np.ndarray:
        """Probability of each unit."""
        if not texts:
            return np.zeros(0)
        rows, grams = ngram_ids(texts)
        total = np.bincount(rows, self.weights[grams], minlength=len(texts))
        size = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(size) + self.bias, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the most harmful unit of each text."""
        bags = [units(t) for t in texts]
        known = {u: i for i, u in enumerate(dict.fromkeys(u for b in bags for u in b))}
        scores = np.concatenate([self.score_units(list(known)[i : i + 2000]) for i in range(0, len(known), 2000)] or [np.zeros(0)])
        return np.array([max((scores[known[u]] for u in b), default=0.0) for b in bags])


def _fit(rows: np.ndarray, grams: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Naive Bayes ratios, then logistic regression over the ratio-scaled features by full-batch AdaGrad."""
    positive = np.bincount(grams, (weight * y)[rows], minlength=1 << BITS) + 1
    negative = np.bincount(grams, (weight * (1 - y))[rows], minlength=1 << BITS) + 1
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    ratio[((positive + negative) < 3) | (np.abs(ratio) < 0.4)] = 0  # an n-gram met once, or equally often, says nothing
    keep = ratio[grams] != 0
    used, column = np.unique(grams[keep], return_inverse=True)
    r = rows[keep]
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    x = ratio[used][column] / size[r]
    w, b = np.full(len(used), 0.1), 0.0
    weight = np.where(y > 0.5, weight / max(1e-9, (weight * y).sum()), weight / max(1e-9, (weight * (1 - y)).sum())) / 2
    gw, gb = np.full(len(used), 1e-12), 1e-12
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, x * w[column], minlength=n) + b, -30, 30)))
        error = weight * (p - y)
        dw = np.bincount(column, error[r] * x, minlength=len(used)) + 1e-7 * w
        db = error.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.15 * dw / np.sqrt(gw)
        b -= 0.15 * db / np.sqrt(gb)
    full = np.zeros(1 << BITS)
    full[used] = ratio[used] * w
    return full, b


def train(texts: list[str], labels: np.ndarray, steps: tuple[int, ...] = (15, 20, 60)) -> Model:
    """A model from documents with labels between 0 and 1."""
    labels = (np.asarray(labels) > 0.5).astype(float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS), -30.0)
    bags = [units(t) for t in texts]
    index = {u: i for i, u in enumerate(dict.fromkeys(u for b in bags for u in b))}
    members = [np.array([index[u] for u in b], int) for b in bags]
    n = len(index)
    parts = [(a + at, g) for at in range(0, n, 5000) for a, g in [ngram_ids(list(index)[at : at + 5000])]]
    rows, grams = np.concatenate([a for a, _ in parts]), np.concatenate([g for _, g in parts])
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    harmless = np.zeros(n)
    for m, y in zip(members, labels):
        if y == 0:
            harmless[m] += 1
    positive = np.zeros(n)
    for m, y in zip(members, labels):
        if y == 1:
            positive[m] += 1 / max(1, len(m))
    trusted = np.ones(len(bags), bool)
    full, bias, scores = np.zeros(1 << BITS), 0.0, np.zeros(n)
    for step, steps in enumerate(steps):
        y = (positive > 0) & (harmless < 2)
        weight = np.where(y, positive, np.minimum(harmless + (positive > 0), 3))
        use = weight > 0
        full, bias = _fit(rows[use[rows]], grams[use[rows]], n, y.astype(float), np.where(use, weight, 0), steps)
        scores = 1 / (1 + np.exp(-np.clip(np.bincount(rows, full[grams], minlength=n) / size + bias, -30, 30)))
        best = np.array([scores[m].max() if len(m) else 0 for m in members])
        # documents that contradict the rest by far are raters' errors
        trusted = ~((labels == 0) & (best > 0.9)) & ~((labels == 1) & (best < 0.3)) if step else trusted
        positive, harmless = np.zeros(n), np.zeros(n)
        for m, label, t in zip(members, labels, trusted):
            if not len(m) or not t:
                continue
            if label == 1:
                top = m[scores[m] >= max(0.5, scores[m].max() - 0.05)] if step else m[[scores[m].argmax()]]
                positive[top] += 1
            else:
                harmless[m] += 1
    return Model(full, bias)


def fit(documents: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, train_docs: int = 4000) -> Model:
    """The model of the labelled documents; at most `train_docs` of them reach the driver."""
    votes = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("_y")).where(F.col("_y") != 0.5)
    chosen = votes.orderBy(F.xxhash64(key), key).limit(train_docs)
    pdf = documents.select(key, text).join(F.broadcast(chosen), key).dropDuplicates([key]).orderBy(key).toPandas()
    return train(pdf[text].tolist(), pdf["_y"].to_numpy(float))


def score_documents(documents: DataFrame, model: Model, *, key: str, text: str, keep: list[str] = []) -> DataFrame:
    """(key, keep, score, harmful) of every row; one narrow pass."""
    fields = [documents.schema[c] for c in (key, *keep)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("harmful", T.BooleanType())])
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                score = own.score(part.iloc[:, -1].tolist())
                out = part.iloc[:, :-1].assign(score=score.round(6), harmful=score >= own.threshold)
                out.columns = schema.names
                yield out

    return documents.select(key, *keep, F.col(text).alias("_text")).mapInPandas(run, schema)
