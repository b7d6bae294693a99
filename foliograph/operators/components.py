"""Connected components of a graph as DataFrames, and groups streamed to Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources.store import drop, settle


def connected_components(pairs: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `pairs`; the component is its smallest node.

    Large-star and small-star steps: each moves links closer to the smallest node of
    their neighbourhood, so the rounds grow with the logarithm of the diameter; an error if they do not end. A
    round is two aggregations without any row per pair of a group. A link of a node
    with itself puts the node there alone; nulls are dropped.
    """
    links = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    alone = links.select("u").union(links.select("v")).distinct()
    links = settle(links.where(F.col("u") != F.col("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where(F.col("u") != F.col("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").where(F.col("v") != F.col("m")).union(least.select("u", "m"))
        moved = settle(small.toDF("u", "v").distinct())
        drop(links)
        links = moved
        # a star forest is reached when nothing moves; sums of hashes over the links tell
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components have not settled after {most_rounds} rounds")
    return alone.join(links.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(
        F.col("u").alias("node"), F.coalesce("v", "u").alias("component")
    )


def groups_in_order(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Groups of rows that arrive sorted by `key`; only the group at hand is held."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        start = 0
        for cut in cuts:
            yield keys[start], batch.iloc[start:cut]
            start = cut
        rest = batch.iloc[start:]
    if rest is not None and len(rest):
        yield rest[key].iloc[0], rest
