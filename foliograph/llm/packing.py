"""Filling fixed-capacity containers: minimum bin slack over windows of items.

Items are dealt to windows by a hash of their key, so a window holds about
`window_rows` items however many there are, and windows are filled independently.
Inside a window only the multiset of lengths matters: each container starts with
the largest remaining length, and a bitset dynamic program over the remaining
lengths (with their counts) finds the multiset that comes closest to the rest of
the capacity; backtracking the bitsets gives the counts to take.

Defined cases: an item above the capacity is cut into full pieces, each a container
of its own, and one last piece that is packed like an item; an item of size zero
or null takes no room and joins the last container of its window; repeated keys
are packed once (with the largest size); a null key is dropped.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.sources.store import row_bound


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to `room` as it can get from below."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left > 0:
            take = min(unit, left)
            new = reach | (reach << (length * take)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
                if reach >> room & 1:
                    break
            left -= take
            unit *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += take
            total -= length * take
    return dict(taken)


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (index of the item, number of its piece, tokens)."""
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    containers: list[list[tuple[int, int, int]]] = []
    empty: list[int] = []
    for i in range(len(sizes) - 1, -1, -1):
        size, piece = sizes[i], 0
        while size > capacity:
            containers.append([(i, piece, capacity)])
            size, piece = size - capacity, piece + 1
        if size > 0:
            stacks[size].append((i, piece))
        else:
            empty.append(i)
    counts = {n: len(s) for n, s in stacks.items()}
    while counts:
        largest = max(counts)
        chosen = defaultdict(int, {largest: 1})
        counts[largest] -= 1
        for length, k in closest({n: c for n, c in counts.items() if c}, capacity - largest).items():
            chosen[length] += k
            counts[length] -= k
        containers.append([(*stacks[n].pop(), n) for n, k in chosen.items() for _ in range(k)])
        counts = {n: c for n, c in counts.items() if c}
    if empty:
        if not containers:
            containers.append([])
        containers[-1].extend((i, 0, 0) for i in sorted(empty))
    return containers


def pack(df: DataFrame, *, key: str, size: str, capacity: int, rows: int | None = None, window_rows: int = 8192) -> DataFrame:
    """(key, piece, n_tokens, container) of every item; container is `window-number`.

    `rows` is the number of items where the caller knows it; else `df` is counted.
    """
    kind = df.schema[key].dataType
    windows = max(1, -(-(row_bound(df) if rows is None else rows) // window_rows))
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("container", T.StringType()),
        ]
    )

    def window(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_key"], ignore_index=True)
        keys = pdf["_key"].tolist()
        rows = [
            (keys[i], piece, n, f"{group[0]}-{c}")
            for c, content in enumerate(fill(pdf["_size"].tolist(), capacity))
            for i, piece, n in content
        ]
        return pd.DataFrame(rows, columns=schema.names)

    items = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.coalesce(F.col(size).cast("int"), F.lit(0))).alias("_size"))
    )
    return items.groupBy(F.pmod(F.xxhash64("_key"), F.lit(windows)).alias("_window")).applyInPandas(window, schema)
