import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fotoloom.llm.cooccurrence import cooccurrence

SCHEMA = "id int, tags array<string>, a string, n_ab int"  # with clashing names


@pytest.mark.parametrize("block", [2, 3, 64])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    words = [f"w{k}" for k in range(30)] + ["É", "e", "zz top"]
    baskets = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 20]))] for _ in range(80)]
    baskets += [words, None, [None, " ", ""], [" W1 ", "w1", "W2"], ["w1", "w2"], ["w1", "w2"]]
    got = cooccurrence(spark.createDataFrame([(k, b, "x", 1) for k, b in enumerate(baskets)], SCHEMA), "tags", block).collect()
    sets = [{t.strip().lower() for t in b or [] if t and t.strip()} for b in baskets]
    one, two, n = Counter(t for s in sets for t in s), Counter(p for s in sets for p in combinations(sorted(s), 2)), sum(bool(s) for s in sets)
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {(a, b): (c, one[a], one[b], n) for (a, b), c in two.items()}
    r = max(got, key=lambda r: r.n_ab)
    assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b)) and r.pmi == pytest.approx(math.log2(r.lift))
    assert all(-1 <= r.npmi <= 1 + 1e-9 for r in got)


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, ["a"], "x", 1), (2, [], "x", 1)], SCHEMA)
    assert cooccurrence(df, "tags").count() == 0 and cooccurrence(df.limit(0), "tags").count() == 0


def test_items_always_together(spark):
    got = cooccurrence(spark.createDataFrame([(1, ["a", "b"], "x", 1)], SCHEMA), "tags").first()
    assert (got.lift, got.npmi) == (1.0, 1.0)


def test_one_huge_basket_is_spread_over_all_tasks(spark):
    """20,000 items in one row: its chunks, and the units of two of them, lie in every partition; counts are whole."""
    from fotoloom.llm import cooccurrence as C

    n, block = 20_000, 2_000
    df = spark.range(1).selectExpr(f"transform(sequence(1, {n}), k -> lpad(k, 6, '0')) as _items")
    chunks, units = C._chunk_pairs(df, block)
    assert chunks.count() == 10 and units.count() == 45
    assert units.agg(F.sum(F.size("_left") * F.size("_right"))).first()[0] == 45 * block * block
    tasks = chunks.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in tasks) <= 6
    small = spark.range(1).selectExpr("transform(sequence(1, 300), k -> lpad(k, 6, '0')) as _items")
    got = C.pair_counts(small, "_items", 64)
    assert got.where("a < b").count() == 300 * 299 // 2 and got.where("a = b").count() == 300 and got.where("a is null").first()["n"] == 1
    assert got.agg(F.max("n")).first()[0] == 1
