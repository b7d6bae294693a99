"""Combining and cutting rankings: weighted top-k sums, fusion, vector ranking, recall, greedy budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group; partitions cut to k before the shuffle."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(place) <= k)


def weighted_top_sum(df: DataFrame, group: list[str], score: str, key: str, weights: list[float]) -> DataFrame:
    """Sum of the best scores of each group, each times the weight of its place."""
    best = top_k(df, group, [F.desc(score), F.col(key)], len(weights))
    factor = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place"))
    return best.groupBy(*group).agg(F.round(F.sum(F.col(score) * factor), 6).alias("total"), F.count("*").alias("used"))


def best_plus_tail(df: DataFrame, group: list[str], score: str, key: str, share: float = 0.35) -> DataFrame:
    """The best score of each group plus `share` of the mean of the second and third."""
    best = top_k(df, group, [F.desc(score), F.col(key)], 3)
    tail = F.avg(F.when(F.col("place") > 1, F.col(score)))
    return best.groupBy(*group).agg(F.round(F.max(score) + share * F.coalesce(tail, F.lit(0.0)), 6).alias("total"))


def fuse(left: DataFrame, right: DataFrame, *, group: str | list[str], key: str, weight: float, k: int, rrf_k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings (group, key, place).

    A place counts w * (rrf_k + 1) / (rrf_k + place), an absent side nothing; a side of
    weight 0 is left out. With `allowed` (group, key) only those keys stay. Ties: place on
    the left, then on the right (absent last), then the key.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie between 0 and 1")
    groups = [group] if isinstance(group, str) else group
    a = left.select(*groups, key, F.col("place").alias("pl")).where(F.lit(weight < 1))
    b = right.select(*groups, key, F.col("place").alias("pr")).where(F.lit(weight > 0))
    part = lambda p, w: F.coalesce(F.lit(w * (rrf_k + 1)) / (rrf_k + F.col(p)), F.lit(0.0))
    both = a.join(b, [*groups, key], "full_outer")
    if allowed is not None:
        both = both.join(allowed.select(*groups, key).distinct(), [*groups, key], "left_semi")
    both = both.withColumn("score", F.round(part("pl", 1 - weight) + part("pr", weight), 4))
    order = [F.desc("score"), F.col("pl").asc_nulls_last(), F.col("pr").asc_nulls_last(), F.col(key)]
    return top_k(both, groups, order, k).select(*groups, key, "score", "place")


def hybrid(papers: tuple[DataFrame, DataFrame], sections: tuple[DataFrame, DataFrame], *, weight: float, k: int, k_sections: int, pool: int = 20) -> DataFrame:
    """(query, paper, paper_score, paper_place, section, score, place): papers of two rankings fused, then the sections of each chosen paper.

    papers: rankings (query, paper, place); sections: (query, paper, section, place), places
    counted inside a paper. The pool is max(k, pool) papers and three times as many
    sections as asked for from each side.
    """
    near = [p.where(F.col("place") <= max(k, pool)) for p in papers]
    chosen = fuse(*near, group="query", key="paper", weight=weight, k=k).select("query", "paper", F.col("score").alias("paper_score"), F.col("place").alias("paper_place"))
    held = [s.join(chosen.select("query", "paper"), ["query", "paper"], "left_semi").where(F.col("place") <= 3 * k_sections) for s in sections]
    inner = fuse(*held, group=["query", "paper"], key="section", weight=weight, k=k_sections)
    return chosen.join(inner, ["query", "paper"])


#: query vectors that are sent to the tasks at a time
QUERY_BLOCK = 4000


def cosine_ranking(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score, place) of the k nearest vectors of each query vector (query, vector).

    The stated queries meet all rows, QUERY_BLOCK at a time, as matrix products of Arrow
    batches; of a batch only what may be among a query's k best goes on. A vector is no
    neighbour of the query of its own key; null vectors and keys are left out.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col("query").isNotNull() & F.col(vector).isNotNull()).dropDuplicates(["query"])
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    kind = dict(vectors.dtypes)[key]

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)

    def search(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                for at in range(0, len(batch), 4000):
                    part = batch.iloc[at : at + 4000]
                    keys = part[key].to_numpy()
                    score = unit(np.stack(part[vector].to_numpy()).astype(float)) @ matrix.T
                    score[keys[:, None] == ids[None, :]] = -np.inf
                    keep = np.isfinite(score)
                    if len(keys) > k:  # ties after rounding stay in
                        keep &= score >= np.partition(score, len(keys) - k, axis=0)[len(keys) - k] - 1e-5
                    r, q = np.nonzero(keep)
                    yield pd.DataFrame({"query": ids[q], key: keys[r], "score": score[r, q]})

        return run

    out: DataFrame | None = None
    for b in range(n):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b).select("query", vector).toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast((block["query"].to_numpy(), unit(np.stack(block[vector].to_numpy()).astype(float))))
        part = rows.mapInPandas(search(shared), f"query {dict(queries.dtypes)['query']}, {key} {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query {dict(queries.dtypes)['query']}, {key} {kind}, score double")
    return top_k(out.withColumn("score", F.round("score", 5)), ["query"], [F.desc("score"), F.col(key)], k)


def competition_recall(scores: DataFrame, *, weights: dict[str, float], limit: int, rrf_k: int = 60) -> DataFrame:
    """Papers by the sum of weight / (rrf_k + rank) over kinds; equal scores share a rank.

    scores: query, kind, paper, score. The best score per kind and paper counts; kinds but
    "paper" keep scores above 0 and ranks up to `limit`.
    """
    best = scores.where(F.col("kind").isin(list(weights))).where((F.col("score") > 0) | (F.col("kind") == "paper"))
    best = best.groupBy("query", "kind", "paper").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.rank().over(W.partitionBy("query", "kind").orderBy(F.desc("score"))))
    kept = ranked.where((F.col("rank") <= limit) | (F.col("kind") == "paper"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return kept.groupBy("query", "paper").agg(F.round(F.sum(weight[F.col("kind")] / (rrf_k + F.col("rank"))), 8).alias("total"), F.count("*").alias("channels"))


def coverage_bonus(support: DataFrame, group: list[str]) -> DataFrame:
    """Bonus from the numbers of distinct entities, types, exact entities and sections of (entity, kind, exact, section)."""
    e, t = F.countDistinct("entity"), F.countDistinct("kind")
    x = F.countDistinct(F.when(F.col("exact"), F.col("entity")))
    s = F.countDistinct("section")
    above = lambda n: F.greatest(n - 1, F.lit(0))
    bonus = 0.65 * e + 0.85 * t + 1.1 * above(e) + 1.4 * x + 2.2 * above(x) + 0.25 * s
    return support.groupBy(*group).agg(F.round(bonus, 4).alias("bonus"), e.alias("entities"), t.alias("kinds"), x.alias("exact"), s.alias("sections"))


def within_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Items of each group taken in order while their running size stays within the budget."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)
