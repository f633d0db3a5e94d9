"""How often items stand in the same basket, and how much more often than chance.

Baskets of up to `block` items give their pairs in place. Larger ones are cut into chunks of `block` items, which leave the
task of their basket as rows of their own; from wherever they come to lie, each goes to every unit of two chunks that it is
part of, so that no task ever multiplies out more than `block`^2 pairs at once and one huge basket occupies the whole
cluster. Pairs of both kinds, single items (as pairs with themselves) and baskets (as pairs of nulls) meet in one aggregation
that combines before its shuffle: the input is read once, and what is shuffled is bounded by the different pairs of each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotoloom.scratch import materialize

BLOCK = 64


def tidy_items(items: str | Column) -> Column:
    """Trimmed, in lower case, without null and blank ones, each once; null for a null list."""
    items = F.col(items) if isinstance(items, str) else items
    return F.array_distinct(F.filter(F.transform(items, lambda t: F.lower(F.btrim(t))), lambda t: t.isNotNull() & (t != "")))


def _pairs_within(items: str) -> Column:
    """Every pair (a < b) of a sorted list."""
    c = F.col(items)
    return F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _pairs_across(left: str, right: str) -> Column:
    return F.flatten(
        F.transform(F.col(left), lambda a: F.transform(F.col(right), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    )


def _chunk_pairs(tidy: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Of baskets beyond `block` items: their chunks (`_k` the basket, `_i`, `_left`, `_m` of them), and two of them a row."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_items) - 1) div {block}")), lambda k: F.slice("_items", k * block + 1, block))
    large = tidy.where(F.size("_items") > block).select(F.monotonically_increasing_id().alias("_k"), cut.alias("_chunks"))
    # Written, so that a basket's number stays the same in every use; dealt, so that its chunks do not stay in one task.
    chunks = materialize(large.select("_k", F.size("_chunks").alias("_m"), F.posexplode("_chunks").alias("_i", "_left")), "chunks")
    chunks = chunks.repartition(int(tidy.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k", "_i")
    sent = chunks.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).where("_x <> _i")
    first = F.col("_i") < F.col("_x")
    units = sent.groupBy("_k", F.least("_i", "_x").alias("_lo"), F.greatest("_i", "_x").alias("_hi")).agg(
        F.first(F.when(first, F.col("_left")), ignorenulls=True).alias("_left"), F.first(F.when(~first, F.col("_left")), ignorenulls=True).alias("_right")
    )
    return chunks, units


def pair_counts(baskets: DataFrame, items: str, block: int = BLOCK) -> DataFrame:
    """`a`, `b`, `n`: the baskets that hold both, a < b by code points; those that hold an item where a = b; all that hold one
    where both are null. `items`: sorted lists without repeats, not empty."""
    tidy = baskets.select(F.col(items).alias("_items")).where(F.size("_items") > 0)
    singly = lambda c: F.transform(F.col(c), lambda t: F.struct(t.alias("a"), t.alias("b")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    chunks, units = _chunk_pairs(tidy, block)
    cells = [
        tidy.where(F.size("_items") <= block).select(F.explode(F.concat(_pairs_within("_items"), singly("_items"), whole)).alias("_p")),
        chunks.select(F.explode(F.concat(_pairs_within("_left"), singly("_left"), F.when(F.col("_i") == 0, whole).otherwise(F.slice(whole, 1, 0)))).alias("_p")),
        units.select(F.explode(_pairs_across("_left", "_right")).alias("_p")),
    ]
    return reduce(DataFrame.unionAll, cells).groupBy(F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(baskets: DataFrame, items: str, block: int = BLOCK) -> DataFrame:
    """One row per pair of items that share a basket: `item_a`, `item_b`, `n_ab`, `n_a`, `n_b`, `n`, `lift`, `pmi`, `npmi`.

    n counts the baskets with at least one item. Defined results: items are trimmed and put in lower case; null and blank
    ones do not count; an item counts once per basket; null, empty and one-item baskets give no pairs (the latter count in
    n); equal baskets count each; an empty table gives no pairs; other columns are ignored.
    """
    tidy = baskets.select(F.sort_array(tidy_items(items)).alias("_items")).where(F.size("_items") > 0)
    counts = materialize(pair_counts(tidy, "_items", block), "counts")  # no more rows than there are different pairs
    single = counts.where("a = b").select(F.col("a").alias("_t"), F.col("n").alias("_n"))
    n = counts.where("a is null").select("n").scalar()
    return (
        counts.where("a < b").withColumnRenamed("n", "n_ab")
        .join(single.select(F.col("_t").alias("a"), F.col("_n").alias("n_a")), "a")
        .join(single.select(F.col("_t").alias("b"), F.col("_n").alias("n_b")), "b")
        .withColumn("n", n)
        .withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
        .withColumn("pmi", F.log2("lift"))
        .withColumn("npmi", F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(F.col("pmi") / -F.log2(F.col("n_ab") / F.col("n"))))
        .select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n", "lift", "pmi", "npmi")
    )
