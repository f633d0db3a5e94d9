from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from fotoloom.llm import clusters as C
from fotoloom.llm.packed import packed, unpacked
from fotoloom.llm.components import connected_components, label_components, spanning_forest

SCHEMA = "id int, at timestamp_ntz, v array<float>, comp string, t int, _n int"  # with clashing names
DIM = 16


def made(seed, groups=30, scale=0.08, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=DIM)
        day = int(rng.integers(0, 200))
        for _ in range(int(rng.integers(1, 8))):
            v = centre + rng.normal(size=DIM) * scale * rng.integers(1, 6)
            rows.append((v.tolist(), day + float(rng.integers(0, 45))))
    rows += [rows[0]] * copies
    ids = rng.permutation(10 * len(rows))[: len(rows)] + 1
    return [(int(i), datetime(2024, 1, 1) + timedelta(days=d), [float(np.float32(x)) for x in v], "x", 1, 1) for i, (v, d) in zip(ids, rows)]


def alike(rows, similarity=0.85, days=30):
    x = np.array([r[2] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = np.array([r[1].timestamp() for r in rows])
    a = (x @ x.T >= similarity) & (np.abs(t[:, None] - t[None]) <= days * 86400 + 1e-6)
    np.fill_diagonal(a, True)
    return a


def brute(rows):
    a, ids = alike(rows), np.array([r[0] for r in rows])
    out = set()
    for k in range(len(rows)):
        mine = np.flatnonzero(a[k])
        if len(mine) >= 3 and all((a[m] == a[k]).all() for m in mine):
            out.add((int(ids[mine].min()), int(ids[k])))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,block,copies", [(1, 4096, 0), (2, 4096, 60), (3, 8, 40)])
def test_complete_clusters_and_medoids(spark, seed, block, copies):
    rows = made(seed, copies=copies)
    v = C.verified_records(table(spark, rows), "id", "at", "v", 0.85, 30, DIM, block=block).cache()
    assert {(r.cluster_id, r.id) for r in C.complete_clusters(v, 3).collect()} == brute(rows)
    ids = np.array([r[0] for r in rows])
    # The same rule in one piece, over each component.
    a = alike(rows)
    i, j = np.nonzero(a)
    label = label_components(len(rows), i, j)
    want = {}
    for c in np.unique(label):
        at = np.flatnonzero(label == c)
        m = C.medoids(a[np.ix_(at, at)], ids[at])
        want |= {int(ids[p]): int(ids[at[q]]) for p, q in zip(at, m)}
    got = {r.id: r for r in C.medoid_clusters(v).collect()}
    assert {k: r.cluster_id for k, r in got.items()} == want
    assert all(r.size == list(want.values()).count(r.cluster_id) and 1 <= len(r.typical) <= 3 for r in got.values())
    v.unpersist()


def test_a_loose_component_is_split_round_medoids():
    chain = np.eye(5, dtype=bool)
    for k in range(4):
        chain[k, k + 1] = chain[k + 1, k] = True
    assert C.medoids(chain, np.array([10, 20, 30, 40, 50])).tolist() == [1, 1, 1, 3, 3] or C.medoids(chain, np.array([10, 20, 30, 40, 50])).tolist() == [1, 1, 1, 4, 4]
    assert C.medoids(np.ones((3, 3), bool), np.array([9, 7, 8])).tolist() == [1, 1, 1]


def test_unusable_rows(spark):
    t = datetime(2024, 1, 1)
    good = [1.0] * DIM
    rows = [(1, t, good), (2, t, None), (3, t, []), (4, t, [0.0] * DIM), (5, t, good[:8]), (6, t, [None, *good[1:]]), (7, None, good), (None, t, good), (8, t, good), (9, t, good)]
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)
    got = C.similarity_clusters(df, "id", "at", "v", 0.85, 30, DIM).collect()
    assert {(r.id, r.cluster_id, r.size) for r in got} == {(1, 1, 3), (8, 1, 3), (9, 1, 3)}
    assert C.similarity_clusters(df.limit(0), "id", "at", "v", 0.85, 30, DIM).count() == 0
    lone = C.similarity_clusters(df.where("id = 1"), "id", "at", "v", 0.85, 30, DIM).collect()
    assert [(r.id, r.cluster_id, r.size, r.typical) for r in lone] == [(1, 1, 1, [1])]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(k), int(k + 1)) for k in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (50, 2))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = label_components(300, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {n: int(label[n]) for e in edges for n in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_rounds(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert sorted(map(tuple, connected_components(df, one_task=0).collect())) == sorted(map(tuple, connected_components(df).collect()))


def test_spanning_forest_is_lightest():
    rng = np.random.default_rng(7)
    a, b, w = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    kept = spanning_forest(a, b, w)
    label, want = list(range(60)), 0
    for k in np.argsort(w, kind="stable"):
        if label[a[k]] != label[b[k]]:
            want += w[k]
            label = [label[b[k]] if x == label[a[k]] else x for x in label]
    assert len(kept) == 60 - len(set(label)) and w[kept].sum() == want
    assert len(spanning_forest(a[:0], b[:0], w[:0])) == 0


def test_wide_labels_send_a_sketch_of_each_neighbourhood():
    key, label = np.array([1, 1, 1, 1, 2, 2]), np.array([5, 5, 5, 6, 6, 6])
    sketches = np.array([0, 7, 255, 255, 0, 1], np.uint64)
    assert C._neighbourhoods(key, label, sketches, 4).tolist() == [0, 0, 2, 3, 4, 4]


@pytest.mark.parametrize("hot", [16, 16_384])
def test_the_joins_and_blocks_of_large_tables(spark, monkeypatch, hot):
    """Every way that only large inputs take gives the same: shuffled placements, rounds of components, hot buckets in blocks."""
    rows = made(4, copies=150)
    ways = []
    for large in (False, True):
        if large:
            monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
            monkeypatch.setattr(C, "HOT", hot)
            monkeypatch.setattr(C, "CHUNK", 40)  # many labels, so that buckets hold many rows
            monkeypatch.setattr(C.connected_components, "__defaults__", ("a", "b", 0))
        v = C.verified_records(table(spark, rows), "id", "at", "v", 0.85, 30, DIM)
        ways.append((sorted(map(tuple, C.complete_clusters(v, 3).collect())), sorted((r.id, r.cluster_id, r.size, tuple(r.typical)) for r in C.medoid_clusters(v).collect())))
    assert ways[0] == ways[1]


def test_a_bucket_of_a_hundred_thousand_rows():
    """All alike and in one bucket: the forest joins them all, in bounded pieces and memory."""
    n, kind = 100_000, C._entry(True)
    e = np.zeros(n, kind)
    e["id"], e["low"] = np.arange(n), np.arange(n) // 50
    packed = e.tobytes()
    batch = pa.RecordBatch.from_pylist([dict(part=0, wide=True, entries=packed, a=[], b=[])], schema=pa.schema(
        [("part", pa.int32()), ("wide", pa.bool_()), ("entries", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
    units = {}
    for out in C._forest(C.MINUTE, 5)(iter([batch])):
        for r in out.select(["key", "side", "block", "other", "entries"]).to_pylist():
            if r["key"] is not None:
                assert len(r["entries"]) <= C.HOT * kind.itemsize
                units.setdefault((r["block"], r["other"]), []).append(r)
    blocks = -(-n // C.HOT)
    assert len(units) == blocks * (blocks + 1) // 2
    rows = [dict(key=0, block=b, other=o, side=r["side"], entries=r["entries"]) for (b, o), rs in sorted(units.items()) for r in rs]
    a, b = [], []
    for r in C._hot_forest(C.MINUTE, 5)(iter([pa.RecordBatch.from_pylist([dict(key=x["key"], block=x["block"], other=x["other"], side=x["side"], entries=x["entries"]) for x in rows])])):
        a.append(np.asarray(r.column(0)))
        b.append(np.asarray(r.column(1)))
    a, b = np.concatenate(a), np.concatenate(b)
    assert len(np.unique(label_components(n, a, b))) == 1


def test_sets_of_near_vectors_share_more():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 128))
    y = 0.87 * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(1 - 0.87**2) * rng.normal(size=x.shape) / np.sqrt(128)
    y /= np.linalg.norm(y, axis=1)[:, None]
    ids = pa.array(np.arange(400))

    sets = lambda m: next(C._set_rows(128)(iter([pa.RecordBatch.from_arrays([ids, packed(m)], names=["id", "v"])]))).column(1)
    sx, sy = sets(x), sets(y)
    check = C._jaccard(C.least_jaccard(0.85))
    near = next(check(iter([pa.RecordBatch.from_arrays([ids, ids, sx, sy], names=list("abxy"))])))
    far = next(check(iter([pa.RecordBatch.from_arrays([ids, ids, sx, pa.array(sy.to_pylist()[::-1], pa.binary())], names=list("abxy"))])))
    assert near.num_rows >= 396 and far.num_rows == 0


def test_packed_vectors_round_trip():
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    column = packed(m)
    assert (unpacked(column, 3) == m).all() and (unpacked(column.slice(1, 2), 3) == m[1:3]).all() and unpacked(column.slice(0, 0), 3).shape == (0, 3)
    assert column.to_pylist()[2] == m[2].tobytes()
