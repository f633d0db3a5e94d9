"""Filling containers of fixed capacity with items of varying size.

Pieces that fill a container by themselves are containers at once. All other items are dealt by hash into groups of about
`group_items`, and each group is packed by conflict-constrained best fit, largest items first: open bins are ordered by
what room they have left, a bitmap of the rooms that occur finds the successor of an item's size, and the search goes on
from room to room until the tightest bin is found whose bitmaps of duplicate clusters and sources agree with the item's.
At most the last few bins of a group stay partly empty, so the loss vanishes against its thousands of bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotoloom.scratch import materialize

GROUP_ITEMS = 25_000


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], apart: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes must be in descending order.

    clusters: a number shared by copies, -1 for items that have none. sources: a number each, -1 for none. apart[s]: the
    bitmap of sources that source s must not meet.
    """
    members = pd.Series(clusters).value_counts()
    bit = {c: 1 << k for k, c in enumerate(c for c, n in members.items() if n > 1 and c >= 0)}
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left, as opened or refilled
    rooms = 0  # bit r: some bin has room r
    cluster_bits: list[int] = []
    source_bits: list[int] = []
    out: list[int] = []
    last: tuple = ()
    at_room, at_bin = 0, 0
    for size, cluster, source in zip(sizes, clusters, sources):
        own, shunned = bit.get(cluster, 0), apart[source] if source >= 0 else 0
        mark = 1 << source if source >= 0 else 0
        # Copies come one after the other: every bin passed over for the one before holds a copy, and is passed over again.
        if not (own and last == (size, cluster, source)):
            at_room, at_bin = size, 0
        last = (size, cluster, source)
        found = -1
        while found < 0:
            above = rooms >> at_room
            if not above:
                break
            step = (above & -above).bit_length() - 1
            if step:
                at_room, at_bin = at_room + step, 0
            row = waiting[at_room]
            while at_bin < len(row):
                b = row[at_bin]
                if not (own and cluster_bits[b] & own) and not source_bits[b] & shunned:
                    found = b
                    break
                at_bin += 1
            if found < 0:
                at_room, at_bin = at_room + 1, 0
                if at_room > capacity:
                    break
        if found < 0:
            found, room = len(cluster_bits), capacity
            cluster_bits.append(0)
            source_bits.append(0)
        else:
            room = at_room
            row = waiting[room]
            row.pop(at_bin)
            if not row:
                rooms &= ~(1 << room)
        cluster_bits[found] |= own
        source_bits[found] |= mark
        waiting[room - size].append(found)
        rooms |= 1 << (room - size)
        out.append(found)
    return out


def fill_containers(
    items: DataFrame,
    item_id: str,
    size: str,
    capacity: int,
    cluster: str | None = None,
    source: str | None = None,
    sources_apart: tuple[tuple[str, str], ...] = (),
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """One row per piece: `container` (string), `position` (from 1), item_id, `piece` (from 0), `start` and `length`.

    Items larger than the capacity, and only those, are divided, into pieces that fill containers and a rest. Two items of
    the same `cluster` (copies) never share a container, nor do items of two sources named in `sources_apart`; pieces that
    fill a container meet nothing. Defined results: null and negative sizes count as 0; items of size 0 take no space but
    stand in a container; a null cluster or source conflicts with nothing, and items of size 0 have no cluster; repeated
    rows are items of their own; an empty table gives no containers; other columns are ignored. The result is the same
    for the same rows and parameters in any order of rows, but for which of two equal rows comes first and for the names of the
    containers that one piece fills, which are only unique.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    none = F.lit(None).cast("string")
    slim = materialize(
        items.select(
            F.col(item_id).alias("_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
            (F.col(cluster).cast("string") if cluster else none).alias("_cluster"), (F.col(source).cast("string") if source else none).alias("_source"),
        ),
        "items",
    )
    full = slim.where(F.col("_size") >= capacity).select(
        F.col("_id"), F.explode(F.sequence(F.lit(0), F.expr(f"cast(_size div {capacity} as int) - 1"))).alias("piece")
    )
    alone = full.select(
        F.concat(F.lit("d"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("-"), F.col("piece").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("container"),
        F.lit(1).alias("position"), F.col("_id"), "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
    )
    rest = slim.where((F.col("_size") % capacity > 0) | (F.col("_size") == 0)).select(
        "_id", F.expr(f"cast(_size div {capacity} as int)").alias("piece"), (F.col("_size") % capacity).alias("length"), "_cluster", "_source"
    )
    groups = max(1, -(-slim.count() // group_items))
    id_type = slim.schema["_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_cluster", "_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        clusters = np.where(pdf["length"] > 0, pd.factorize(pdf["_cluster"])[0], -1)
        source_no, names = pd.factorize(pdf["_source"])
        index, apart = {n: k for k, n in enumerate(names)}, [0] * max(1, len(names))
        for a, b in sources_apart:
            if a in index and b in index:
                apart[index[a]] |= 1 << index[b]
                apart[index[b]] |= 1 << index[a]
        bins = np.array(best_fit(pdf["length"].tolist(), clusters.tolist(), source_no.tolist(), apart, capacity), np.int64)
        group = int(pdf["_g"].iloc[0])
        return pd.DataFrame(
            {
                "container": [f"g{group}-{b}" for b in bins],
                "position": pd.Series(bins).groupby(bins).cumcount().to_numpy(np.int32) + np.int32(1),
                "_id": pdf["_id"],
                "piece": pdf["piece"],
                "start": pdf["piece"].to_numpy(np.int64) * capacity,
                "length": pdf["length"],
            }
        )

    packed = (
        rest.withColumn("_g", F.pmod(F.xxhash64("_id", "piece"), F.lit(groups)).cast("int"))
        .groupBy("_g")
        .applyInPandas(pack, f"container string, position int, _id {id_type}, piece int, start long, length long")
    )
    return packed.unionByName(alone).withColumnRenamed("_id", item_id)
