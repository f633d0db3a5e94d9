"""Runs of (nearly) the same event in ordered sequences, collapsed to one row each.

The whole table is sorted once by (entity, time, id) over all tasks, so the longest sequence is cut wherever a range of
rows ends and no entity has to fit into a task. Each event is canonicalised to whether it continues the event before it
(close in time, both vectors usable, similar enough); within a range, row number minus row number among events of the same
canonical value is constant exactly along a run. Runs that touch the end of a range are joined with their continuation in
the next one by a table of at most two rows per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotoloom.functions.arrays import usable_matrix
from fotoloom.functions.times import micros
from fotoloom.scratch import materialize

_LINKS = "block int, seq long, entity string, t long, id long, linked boolean, prev_t long, prev_id long, tail boolean, edge array<float>"


def _linker(dim: int, gap: int, similarity: float):
    """For each row in order, whether it continues the row before. A range's first row stays open and carries its vector;
    so does a repetition (`tail`) of its last row."""
    schema = pa.schema(
        [
            ("block", pa.int32()), ("seq", pa.int64()), ("entity", pa.string()), ("t", pa.int64()), ("id", pa.int64()),
            ("linked", pa.bool_()), ("prev_t", pa.int64()), ("prev_id", pa.int64()), ("tail", pa.bool_()), ("edge", pa.list_(pa.float32())),
        ]
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq, carry = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            entity, t, ids = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            ok, rows = usable_matrix(batch.column(3), dim)
            full = np.zeros((n, dim), np.float32)
            full[ok] = rows
            names = np.asarray(entity.to_pandas(), dtype=object)
            first = carry is None
            if not first:
                names, t0, i0 = np.concatenate([[carry[0]], names]), np.concatenate([[carry[1]], t]), np.concatenate([[carry[2]], ids])
                full = np.vstack([carry[3][None], full])
            else:
                t0, i0 = t, ids
            a, b = full[:-1].astype(np.float64), full[1:].astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            dot = np.einsum("ij,ij->i", a, b)
            linked = (names[1:] == names[:-1]) & (t0[1:] - t0[:-1] <= gap) & (norm > 0) & (dot >= similarity * norm)
            flag, pt, pi = linked.tolist(), t0[:-1], i0[:-1]
            if first:
                flag, pt, pi = [None, *flag], np.concatenate([[0], pt]), np.concatenate([[0], pi])
            edge = [full[0].tolist() if first and full[0].any() else None] + [None] * (n - 1)
            yield pa.record_batch(
                [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(seq, seq + n)), entity, pa.array(t), pa.array(ids),
                 pa.array(flag, pa.bool_()), pa.array(pt, pa.int64()), pa.array(pi, pa.int64()), pa.array(np.zeros(n, bool)), pa.array(edge, pa.list_(pa.float32()))],
                schema=schema,
            )
            seq += n
            carry = (names[-1], int(t[-1]), int(ids[-1]), full[-1])
        if carry is not None:
            vector = carry[3].tolist() if carry[3].any() else None
            yield pa.record_batch(
                [pa.array([block], pa.int32()), pa.array([seq - 1]), pa.array([carry[0]], pa.string()), pa.array([carry[1]]), pa.array([carry[2]]),
                 pa.array([None], pa.bool_()), pa.array([0]), pa.array([0]), pa.array([True]), pa.array([vector], pa.list_(pa.float32()))],
                schema=schema,
            )

    return links


def collapse_runs(
    events: DataFrame, entity: str, time: str, row_id: str, vector: str, max_gap_seconds: float, min_similarity: float, dim: int
) -> DataFrame:
    """One row per run of two or more: `entity`, `first_id`, `last_id`, `events`, `first_t`, `last_t` (microseconds), `seconds`.

    An event continues the one before it (of its entity, by time, then id) if it follows within `max_gap_seconds`
    (inclusive), both vectors are usable (`dim` components, none null, not all zero) and their cosine is at least
    `min_similarity`. Defined results: events with a null entity, time or id are left out; an unusable vector ends a run;
    repeated rows are events of their own; an empty table has no runs; other columns are ignored.
    """
    slim = events.select(
        F.col(entity).cast("string").alias("entity"), micros(time).alias("t"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")
    ).where("entity is not null and t is not null and id is not null")
    ranged = slim.repartitionByRange("entity", "t", "id").sortWithinPartitions("entity", "t", "id")
    gap = round(max_gap_seconds * 1_000_000)
    rows = materialize(ranged.mapInArrow(_linker(dim, gap, min_similarity), _LINKS), "links")

    # The first row of each range against the last row of the range before: two rows per range.
    order = Window.orderBy("block", "seq", "tail")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    first = (
        rows.where("tail or seq = 0")
        .where("tail or linked is null")
        .select("*", *(F.lag(c).over(order).alias(f"_{c}") for c in ("entity", "t", "id", "edge", "block")))
        .where("not tail")
        .select(
            "block",
            F.coalesce(
                (F.col("entity") == F.col("_entity")) & (F.col("t") - F.col("_t") <= gap)
                & (dot("edge", "_edge") >= min_similarity * F.sqrt(dot("edge", "edge") * dot("_edge", "_edge"))),
                F.lit(False),
            ).alias("_linked"),
            F.col("_t").alias("_pt"), F.col("_id").alias("_pi"), F.col("_block").alias("_before"),
        )
    )
    ends = rows.where("tail").select("block", F.col("seq").alias("_last"))
    edges = F.broadcast(materialize(first.join(ends, "block"), "edges"))  # one row per range
    is_first = F.col("seq") == 0
    events_ = rows.where("not tail").join(edges, "block").select(
        "block", "seq", "entity", "t", "id", "_last", "_before",
        F.when(is_first, F.col("_linked")).otherwise(F.col("linked")).alias("linked"),
        F.when(is_first, F.col("_pt")).otherwise(F.col("prev_t")).alias("prev_t"),
        F.when(is_first, F.col("_pi")).otherwise(F.col("prev_id")).alias("prev_id"),
    )
    place = Window.partitionBy("block", "entity").orderBy("seq")
    alike = Window.partitionBy("block", "entity", "linked").orderBy("seq")
    runs = (
        events_.withColumn("_run", F.row_number().over(place) - F.row_number().over(alike))
        .where("linked")
        .groupBy("block", "entity", "_run")
        .agg(
            F.min("seq").alias("_from"), F.max("seq").alias("_to"), F.min(F.struct("seq", "prev_t", "prev_id")).alias("_a"),
            F.max(F.struct("seq", "t", "id")).alias("_b"), F.first("_last").alias("_last"), F.first("_before").alias("_before"), F.count(F.lit(1)).alias("_n"),
        )
        .select(
            "block", "entity", "_from", "_before", F.col("_a.prev_t").alias("first_t"), F.col("_a.prev_id").alias("first_id"), F.col("_b.t").alias("last_t"),
            F.col("_b.id").alias("last_id"), "_n", (F.col("_from") == 0).alias("_opens"), (F.col("_to") == F.col("_last")).alias("_closes"),
        )
    )
    runs = materialize(runs, "runs")
    # Runs that touch a range's end, at most two per range, are joined in order.
    chain = Window.orderBy("block", "_from")
    touching = (
        runs.where("_opens or _closes")
        .withColumn("_new", F.coalesce(~(F.col("_opens") & F.lag("_closes").over(chain) & (F.lag("block").over(chain) == F.col("_before"))), F.lit(True)).cast("int"))
        .withColumn("_chain", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "_chain")
        .agg(
            F.min(F.struct("block", "_from", "first_t", "first_id")).alias("_a"), F.max(F.struct("block", "_from", "last_t", "last_id")).alias("_b"),
            F.sum("_n").alias("_n"),
        )
        .select("entity", F.col("_a.first_t").alias("first_t"), F.col("_a.first_id").alias("first_id"), F.col("_b.last_t").alias("last_t"), F.col("_b.last_id").alias("last_id"), "_n")
    )
    whole = runs.where("not (_opens or _closes)").select(touching.columns)
    return whole.unionByName(touching).select(
        "entity", "first_id", "last_id", (F.col("_n") + 1).alias("events"), "first_t", "last_t", ((F.col("last_t") - F.col("first_t")) / F.lit(1e6)).alias("seconds")
    )
