import random
from collections import defaultdict

import pytest

from fotoloom.llm.packing import best_fit, fill_containers

SCHEMA = "id long, size long, copies long, source string, container int, piece string"  # with clashing names


def plain_best_fit(sizes, clusters, sources, apart, capacity):
    room, held, met, out = [], [], [], []
    many = {c for c in clusters if c >= 0 and clusters.count(c) > 1}
    for s, c, q in zip(sizes, clusters, sources):
        fits = [b for b in range(len(room)) if room[b] >= s and not (c in many and c in held[b]) and not (q >= 0 and any(apart[q] >> o & 1 for o in met[b]))]
        if fits:
            b = min(fits, key=lambda b: room[b])
            tight = {x for x in fits if room[x] == room[b]}
        else:
            b, tight = len(room), {len(room)}
            room.append(capacity)
            held.append(set())
            met.append(set())
        out.append((b, tight))
        room[b] -= s
        held[b].add(c)
        if q >= 0:
            met[b].add(q)
    return out, len(room)


@pytest.mark.parametrize("seed", range(6))
def test_as_tight_as_plain_best_fit(seed):
    rng = random.Random(seed)
    n = 200
    sizes = sorted((rng.randrange(0, 40) for _ in range(n)), reverse=True)
    clusters = [rng.choice([-1, -1, 1, 2, 3]) if s else -1 for s in sizes]
    rows = sorted(zip(sizes, clusters, (rng.randrange(3) for _ in range(n))), key=lambda r: (-r[0], r[1]))
    sizes, clusters, sources = (list(c) for c in zip(*rows))
    apart = [0b010, 0b001, 0] if seed % 2 else [0, 0, 0]
    bins = best_fit(sizes, clusters, sources, apart, 40)
    _, n_plain = plain_best_fit(sizes, clusters, sources, apart, 40)
    load, copies, met = defaultdict(int), defaultdict(list), defaultdict(set)
    for b, s, c, q in zip(bins, sizes, clusters, sources):
        load[b] += s
        copies[b].append(c)
        met[b].add(q)
    assert max(load.values()) <= 40 and all(len([c for c in v if c >= 0]) == len({c for c in v if c >= 0}) for v in copies.values())
    assert not any(apart[a] >> b & 1 for v in met.values() for a in v for b in v)
    assert abs(len(load) - n_plain) <= 1 + n_plain // 20


def check(rows, items, capacity):
    pieces, load, copies = defaultdict(list), defaultdict(int), defaultdict(list)
    cluster = {i: c for i, _, c, *_ in items}
    for r in rows:
        pieces[r.id].append((r.piece, r.start, r.length))
        load[r.container] += r.length
        if r.length < capacity and r.length:
            copies[r.container].append(cluster[r.id])
    assert max(load.values()) <= capacity
    for i, size, *_ in items:
        size = max(size or 0, 0)
        parts = sorted(pieces[i])
        assert sum(p[2] for p in parts) == size and [p[0] for p in parts] == list(range(len(parts)))
        assert all(p[1] == capacity * p[0] for p in parts) and (len(parts) == 1 or size > capacity)
    assert all(len([c for c in v if c is not None]) == len({c for c in v if c is not None}) for v in copies.values())
    return load


@pytest.mark.parametrize("group", [50, 10_000])
def test_containers(spark, group):
    rng = random.Random(group)
    items = [(k, rng.choice([0, 5, 90, 100, 101, 250, None, -3, rng.randrange(100)]), rng.choice([None, 1, 2, k]), rng.choice(["a", "b", None]), 1, "x") for k in range(400)]
    got = fill_containers(spark.createDataFrame(items, SCHEMA), "id", "size", 100, "copies", "source", group_items=group)
    rows = got.collect()
    check(rows, items, 100)
    assert len({(r.container, r.position) for r in rows}) == len(rows)
    apart = fill_containers(spark.createDataFrame(items, SCHEMA), "id", "size", 100, "copies", "source", (("a", "b"),), group_items=group).collect()
    source = {i[0]: i[3] for i in items}
    met = defaultdict(set)
    for r in apart:
        met[r.container].add(source[r.id])
    assert not any({"a", "b"} <= v for v in met.values())


def test_little_space_is_left(spark):
    rng = random.Random(9)
    items = [(k, rng.randrange(1, 1200), None, "a", 1, "x") for k in range(5000)]
    load = check(fill_containers(spark.createDataFrame(items, SCHEMA), "id", "size", 2048, "copies", "source").collect(), items, 2048)
    assert sum(load.values()) / (2048 * len(load)) > 0.99


def test_a_flood_of_copies(spark):
    items = [(k, 30, 7, "a", 1, "x") for k in range(3000)] + [(5000 + k, 20, 5000 + k, "a", 1, "x") for k in range(1000)]
    check(fill_containers(spark.createDataFrame(items, SCHEMA), "id", "size", 100, "copies", "source").collect(), items, 100)


def test_no_items(spark):
    assert fill_containers(spark.createDataFrame([], SCHEMA), "id", "size", 10).count() == 0
