import numpy as np

from fotoloom.llm import neighbours as N

DIM = 16


def corpus(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, DIM))
    x = (centres[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, DIM))).astype(np.float32)
    return x, spark.createDataFrame([(k + 1, x[k].tolist(), 7, 0.5) for k in range(n)], "id int, v array<float>, q int, sim double").repartition(3)


def brute(x, k, top):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u @ u[k]
    s[k] = -2
    return np.lexsort((np.arange(len(x)), -s))[:top] + 1, np.sort(s)[::-1][:top]


def test_recall_and_exact_similarities(spark):
    x, df = corpus(spark)
    got = N.nearest(df, df.where("id % 20 = 0"), "id", "v", "id", "v", 10, DIM).toPandas()
    assert len(got) == 10 * 150 and set(got["rank"]) == set(range(1, 11))
    hits, first = 0, 0
    for q, part in got.groupby("query_id"):
        want, sims = brute(x, q - 1, 10)
        hits += len(set(want) & set(part.neighbour_id))
        best = part.sort_values("rank")
        if best.neighbour_id.iloc[0] == want[0]:
            first += 1
            assert abs(best.similarity.iloc[0] - sims[0]) < 1e-12
        assert q not in set(part.neighbour_id) and best.similarity.is_monotonic_decreasing
    assert hits / (10 * 150) >= 0.9 and first > 130


def test_many_queries_by_shuffle_give_the_same(spark, monkeypatch):
    _, df = corpus(spark, 600)
    asked = df.where("id % 5 = 0")
    few = N.nearest(df, asked, "id", "v", "id", "v", 3, DIM).collect()
    monkeypatch.setattr(N, "FEW_QUERIES", 30)
    monkeypatch.setattr(N, "SLICE", 100)  # parts of several slices
    many = N.nearest(df, asked, "id", "v", "id", "v", 3, DIM).collect()
    assert sorted((r.query_id, r["rank"], r.neighbour_id) for r in many) == sorted((r.query_id, r["rank"], r.neighbour_id) for r in few)
    assert max(abs(a.similarity - b.similarity) for a, b in zip(sorted(few), sorted(many))) < 1e-12


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(1000, DIM)).astype(np.float32)
    label = N.balanced_parts(x, N.nearest_within(x, 5), 16)
    assert np.bincount(label, minlength=16).min() >= 62 and np.bincount(label).max() <= 63


def test_few_rows_ties_and_unusable_vectors(spark):
    good = [1.0] * DIM
    rows = [(5, good), (3, good), (4, good), (9, None), (8, []), (7, [0.0] * DIM), (6, good[:4]), (None, good), (2, [None, *good[1:]])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = N.nearest(df, df, "id", "v", "id", "v", 10, DIM).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbour_id) for r in got] == [(3, 4), (3, 5), (4, 3), (4, 5), (5, 3), (5, 4)]
    assert N.nearest(df.limit(0), df, "id", "v", "id", "v", 10, DIM).count() == 0
    assert N.nearest(df, df.limit(0), "id", "v", "id", "v", 10, DIM).count() == 0


def test_unusable_vectors_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW_QUERIES", 0)
    test_few_rows_ties_and_unusable_vectors(spark)
