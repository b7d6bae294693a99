"""References to records that do not exist: a skew-aware temporal anti-join.

References are pre-aggregated per key and period, and each such group is compared
with the lifetimes of its key. A group whose whole time range lies inside one
lifetime is clean and never touches a row again, which is what becomes of almost
every hot key. Only the remaining keys go back to their rows: keys holding more
than a `1 / heavy_share` part of all references (so fewer than `heavy_share` of
them exist at any size) by a broadcast, the other keys by a shuffle join.

A record is live at t if ingested_at <= t and deleted_at is null or > t. States:
`missing` no record has the key; `late` all of its records came after t;
`deleted` otherwise. Null and empty references are no references; a row without
a time is compared with no lifetime and is `missing` or `late`; exact copies of a
row count once; a target table without rows makes every reference `missing`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.sources.store import row_bound


def lifetimes(records: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """Per key the lifetimes of its records, those with one end as one: the earliest of them contains the others.

    Re-deliveries of a record that lives on thus collapse before the shuffle, however many they are.
    """
    return (
        records.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("ref"), F.col(died).alias("died"))
        .agg(F.min(born).alias("born"))
        .groupBy("ref")
        .agg(F.collect_list(F.struct("born", "died")).alias("lives"))
    )


def _state(lives: Column, t: Column) -> Column:
    """The state at t of a reference whose key has `lives`; null if it is live."""
    live = F.exists(lives, lambda x: (x.born <= t) & (x.died.isNull() | (x.died > t)))
    late = F.forall(lives, lambda x: F.coalesce(x.born > t, F.lit(True)))
    return F.when(lives.isNull(), "missing").when(live, None).when(late, "late").otherwise("deleted")


def orphan_references(
    rows: DataFrame,
    records: DataFrame,
    *,
    row_key: str,
    sides: dict[str, str],
    at: str,
    kind: str,
    key: str,
    born: str,
    died: str,
    heavy_share: int = 2000,
) -> DataFrame:
    """(row_key, kind, side, ref, at, state) of each reference without a live record.

    `sides` maps the name of a side to its column. `heavy_share` bounds the rows of
    the broadcast: at most that many keys can be heavy.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("ref")) for s, c in sides.items()])
    refs = (
        rows.select(F.col(row_key).alias("_row"), F.col(kind).alias("_kind"), F.col(at).alias("_at"), F.explode(pairs).alias("_p"))
        .select("_row", "_kind", "_at", "_p.side", "_p.ref")
        .where(F.col("ref").isNotNull() & (F.col("ref") != ""))
    )
    period = F.trunc(F.col("_at").cast("date"), "month")
    groups = (
        refs.groupBy("ref", period.alias("period"))
        .agg(F.count("*").alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
        .groupBy("ref")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("lo", "hi")).alias("spans"))
    )
    clean = F.forall(
        "spans",
        lambda s: F.exists("lives", lambda x: (x.born <= s.lo) & (x.died.isNull() | (x.died > s.hi))),
    )
    suspects = (
        groups.join(lifetimes(records, key, born, died), "ref", "left")
        .where(F.col("lives").isNull() | ~F.coalesce(clean, F.lit(False)))
        .select("ref", "n", "lives")
    )
    least = max(1, len(sides) * row_bound(rows) // heavy_share)
    heavy = suspects.where(F.col("n") > least).select("ref", "lives")
    rest = suspects.where(F.col("n") <= least).select("ref", "lives")
    found = refs.join(F.broadcast(heavy), "ref").unionByName(refs.join(rest.hint("shuffle_merge"), "ref"))
    return (
        found.withColumn("state", _state(F.col("lives"), F.col("_at")))
        .where(F.col("state").isNotNull())
        .select(F.col("_row").alias(row_key), F.col("_kind").alias(kind), "side", "ref", F.col("_at").alias(at), "state")
        .distinct()
    )


def orphan_counts(orphans: DataFrame, kind: str, at: str) -> DataFrame:
    """Orphans per kind of row, month, side and state."""
    return orphans.groupBy(
        F.col(kind), F.date_format(F.trunc(F.col(at).cast("date"), "month"), "yyyy-MM").alias("month"), "side", "state"
    ).agg(F.count("*").alias("n_refs"), F.countDistinct("ref").alias("n_keys"))
