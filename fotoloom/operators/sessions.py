"""Sessions of activity by occupancy bitmaps.

Each entity's time axis is cut into cells of 1/36 of the gap, 64 cells to a word, so an entity's whole history is a
sparse bitmap whose length depends on the time it spans and never on how many events it has: a third of all events may
belong to one entity, and the windows below still see at most one row per word of time. The bitmap is closed
morphologically (dilated by doubling shifts, then eroded likewise), which joins every two events that are surely within
the gap; runs of the closed bitmap take their exact ends and counts from the cells' statistics, and runs whose exact
distance is within the gap after all are merged. The result is exact to the microsecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotoloom.functions.times import from_micros, micros

CELLS_PER_GAP = 36
WORD = 64


def _shifted_left(low: Column, before: Column, n: int) -> Column:
    """The word moved n cells into the future; cells of the word before come in."""
    return F.shiftleft(low, n).bitwiseOR(F.shiftrightunsigned(before, WORD - n))


def _shifted_right(word: Column, after: Column, n: int) -> Column:
    return F.shiftrightunsigned(word, n).bitwiseOR(F.shiftleft(after, WORD - n))


def _doubling(reach: int) -> list[int]:
    """Shifts whose sums make up every distance from 0 to reach."""
    shifts, have = [], 0
    while have < reach:
        step = min(have + 1, reach - have)
        shifts.append(step)
        have += step
    return shifts


def sessions(
    events: DataFrame,
    entity: str,
    time: str,
    row_id: str,
    gap_seconds: float,
    cells_per_gap: int = CELLS_PER_GAP,
) -> DataFrame:
    """One row per session of an entity: a longest stretch in which no event is more than the gap after the one before.

    Columns: `entity`, `first_id`, `last_id` (by time, then id), `start`, `end`, `seconds`, `events`.
    Defined results: events with a null entity, time or id belong to no session; ties of time are ordered by id; repeated
    rows count as often as they occur; a gap of exactly `gap_seconds` does not split; an empty table has no sessions;
    other columns are ignored.
    """
    if not 3 <= cells_per_gap < WORD:
        raise ValueError("cells_per_gap must be from 3 to 63")
    gap = round(gap_seconds * 1_000_000)
    if gap < 0:
        raise ValueError("the gap is negative")
    cell = max(1, gap // cells_per_gap)
    reach = min(gap if cell == 1 else gap // cell - 1, WORD - 2)  # events that many cells apart are surely within the gap
    moment = events.select(
        F.col(entity).alias("_e"), micros(time).alias("_t"), F.col(row_id).alias("_i")
    ).where("_e is not null and _t is not null and _i is not null")

    cells = (
        # Neighbouring cells always form a run, so without any gap only every other cell is used.
        moment.withColumn("_c", F.col("_t") * 2 if gap == 0 else F.expr(f"_t div {cell} - if(_t % {cell} < 0, 1, 0)"))
        .groupBy("_e", "_c")
        .agg(F.min(F.struct("_t", "_i")).alias("_first"), F.max(F.struct("_t", "_i")).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_w", F.shiftright("_c", 6))
        .withColumn("_b", (F.col("_c") - F.shiftleft("_w", 6)).cast("int"))
    )
    # At most 64 cells to a word: the list is bounded.
    words = cells.groupBy("_e", "_w").agg(
        F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_bits"), F.collect_list(F.struct("_b", "_first", "_last", "_n")).alias("_cells")
    )
    line = Window.partitionBy("_e").orderBy("_w")

    def beside(column: str, step: int) -> Column:
        """The neighbouring word, 0 where it is empty."""
        there = F.lag if step < 0 else F.lead
        return F.when(there("_w").over(line) == F.col("_w") + step, there(column).over(line)).otherwise(F.lit(0).cast("long"))

    # Dilation reaches at most the next word (reach < 64), so a word takes it from itself and the word before; `_over` is
    # what a word without events of its own would take from this one.
    far = max(0, reach - 1)
    words = words.select(
        "_e", "_w", "_cells", F.col("_bits").alias("_grown"), beside("_bits", -1).alias("_left"), F.lit(0).cast("long").alias("_over"), F.col("_bits").alias("_own")
    )
    for n in _doubling(far):
        words = words.select(
            "_e", "_w", "_cells",
            F.col("_grown").bitwiseOR(_shifted_left(F.col("_grown"), F.col("_left"), n)).alias("_grown"),
            F.col("_left").bitwiseOR(F.shiftleft("_left", n)).alias("_left"),
            F.col("_over").bitwiseOR(_shifted_left(F.col("_over"), F.col("_own"), n)).alias("_over"),
            F.col("_own").bitwiseOR(F.shiftleft("_own", n)).alias("_own"),
        )
    words = words.withColumn(
        "_right", F.when(F.lead("_w").over(line) == F.col("_w") + 1, F.lead("_grown").over(line)).otherwise(F.col("_over"))
    )
    words = words.withColumn("_closed", F.col("_grown"))
    for n in _doubling(far):
        words = words.select(
            "_e", "_w", "_cells",
            F.col("_closed").bitwiseAND(_shifted_right(F.col("_closed"), F.col("_right"), n)).alias("_closed"),
            F.col("_right").bitwiseAND(F.shiftrightunsigned("_right", n).bitwiseOR(F.lit(-1 << (WORD - n)).cast("long"))).alias("_right"),
        )
    # Runs start where a closed cell follows an open one; each cell's run is the number of starts up to it.
    words = (
        words.withColumn("_top", beside("_closed", -1))
        .withColumn("_starts", F.expr("_closed & ~(shiftleft(_closed, 1) | shiftrightunsigned(_top, 63))"))
        .withColumn("_base", F.coalesce(F.sum(F.bit_count("_starts")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_e", "_starts", "_base", F.explode("_cells").alias("_cell"))
    )
    runs = (
        words.withColumn("_run", F.expr("_base + bit_count(_starts & shiftrightunsigned(-1L, 63 - _cell._b))"))
        .groupBy("_e", "_run")
        .agg(F.min("_cell._first").alias("_first"), F.max("_cell._last").alias("_last"), F.sum("_cell._n").alias("_n"))
    )
    order = Window.partitionBy("_e").orderBy("_first")
    merged = (
        runs.withColumn("_new", F.coalesce(F.col("_first._t") - F.lag("_last._t").over(order) > F.lit(gap), F.lit(True)).cast("int"))
        .withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_e", "_s")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))
    )
    return merged.select(
        F.col("_e").alias("entity"),
        F.col("_first._i").alias("first_id"),
        F.col("_last._i").alias("last_id"),
        from_micros("_first._t").alias("start"),
        from_micros("_last._t").alias("end"),
        ((F.col("_last._t") - F.col("_first._t")) / F.lit(1_000_000.0)).alias("seconds"),
        F.col("_n").alias("events"),
    )
