"""Clusters of mutually similar records, by vector and time.

1. Each unit vector becomes a set: of `GROUPS` groups of directed random projections, the `TOKENS` of each on which it
   reaches farthest. Near vectors share most of their sets, far ones few. A band is one MinHash of each group, so that for
   unrelated vectors the chances multiply; `BANDS` bands, at every size of the table, make candidates. They are gone
   through in rounds of `ROUND` bands, whose shuffles are freed in between.
2. Vectors found alike inside a chunk of a task share a label, and each (band, label) leaves the task once per
   neighbourhood of sketches, so copies and bursts do not multiply. Rows travel packed, some hundreds to a row of Spark's.
3. Within a bucket, rows less than the time limit apart whose 64-bit sketches (other bits for every band) nearly agree are
   candidates; a task hands on those of a minimum spanning forest, closest first. Buckets of more than `HOT` rows are cut
   into blocks, and every two blocks are a unit of work of their own.
4. The exact Jaccard similarity of the two sets verifies each candidate pair; what is left goes into connected components.
5. Components bring the vectors together, once. In each the exact cosine in double precision decides on every pair (the sets
   only approximate what is asked for). Components of more than `BLOCK` records are cut into slices of time and blocks;
   every two blocks of a slice, or of a slice and the next, are a unit of work, dealt over all tasks; a record's results from
   several units add up.
6. Within each component records gather round medoids: a record whose degree is the highest in its own neighbourhood (ties:
   the smaller id) is a medoid, neighbours for which it is the best one join it, and what is left goes on likewise. A
   component in which all are alike thus is one cluster; loose ones are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotoloom.functions.arrays import unit_rows
from fotoloom.functions.times import micros
from fotoloom.llm.components import connected_components, label_components, spanning_forest
from fotoloom.llm.packed import packed_vectors, unpacked
from fotoloom.scratch import materialize

GROUPS = 3
PROJECTIONS = 256  # of a group; a place fits a byte
TOKENS = 16  # of a group
BANDS = 96
ROUND = 32
LABELLING = 8  # bands of a round that label the rows of a chunk
CHUNK = 65_536
HOT = 16_384
BLOCK = 4_096
BROADCAST_ROWS = 2_000_000
#: Parts, among which buckets are dealt by hash, to a task: enough to even tasks out.
PARTS_PER_TASK = 4
SKETCH_DEVIATIONS = 3.0
JACCARD_DEVIATIONS = 3.0
MINUTE = 60_000_000
HOUR = 60 * MINUTE
#: Slices of time are at least so long.
LEAST_SLICE = HOUR


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers scrambled."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def least_jaccard(similarity: float) -> float:
    """What the sets of two vectors of a cosine share, less the deviations allowed: the least similarity of a candidate."""
    share = TOKENS / (2 * PROJECTIONS)
    x = np.linspace(-8, 8, 4001)
    density = np.exp(-x * x / 2)
    upper = np.cumsum(density[::-1])[::-1] / density.sum()
    least = x[np.searchsorted(-upper, -share)]
    tail = x >= least
    s = math.sqrt(max(1e-12, 1 - similarity * similarity))
    beyond = np.array([0.5 * math.erfc((least - similarity * v) / s / math.sqrt(2)) for v in x[tail]])
    both = float((beyond * density[tail]).sum() / density[tail].sum())
    both = max(0.0, both - JACCARD_DEVIATIONS * math.sqrt(both * (1 - both) / (GROUPS * TOKENS)))
    return both / (2 - both)


class Signer:
    """Sets, MinHash bands and sketches of unit vectors; the same in every task."""

    def __init__(self, dim: int, bands: range = range(0), seed: int = 11):
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(dim, GROUPS * PROJECTIONS)).astype(np.float32)
        self.bands = bands
        self.orders = {b: [np.random.default_rng((seed, b, g)).permutation(2 * PROJECTIONS).astype(np.int16) for g in range(GROUPS)] for b in bands}

    def sets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each group (groups x tokens x rows) and the projections."""
        y = x @ self.axes
        out = np.empty((GROUPS, TOKENS, len(x)), np.int16)
        places = np.arange(PROJECTIONS, dtype=np.uint32)
        for g in range(GROUPS):
            z = np.ascontiguousarray(y[:, g * PROJECTIONS : (g + 1) * PROJECTIONS])
            # How far each reaches, without sign, in the upper bits and its place in the lower eight: one sort key, no ties.
            reach = (z.view(np.uint32) & np.uint32(0x7FFFFF00)) | places
            top = (np.partition(reach, PROJECTIONS - TOKENS, axis=1)[:, PROJECTIONS - TOKENS :] & np.uint32(255)).astype(np.int64)
            out[g] = (2 * top + (np.take_along_axis(z, top, 1) > 0)).T
        return out, y

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sketches, a row per band each."""
        n, words = len(x), GROUPS * PROJECTIONS // 64
        keys, bits = np.empty((len(self.bands), n), np.uint64), np.empty((words, n), np.uint64)
        for at in range(0, n, 8192):
            tokens, y = self.sets(x[at : at + 8192])
            part = slice(at, at + y.shape[0])
            bits[:, part] = np.packbits(y > 0, axis=1).view(np.uint64).T
            for k, b in enumerate(self.bands):
                key = np.full(y.shape[0], b + 1, np.uint64)
                for g in range(GROUPS):
                    key = key * np.uint64(4096) + self.orders[b][g][tokens[g]].min(0).astype(np.uint64)
                keys[k, part] = _mixed(key)
        return keys, bits[[b % words for b in self.bands]]


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    change = np.ones(len(columns[0]), bool)
    if len(change) > 1:
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _neighbourhoods(key: np.ndarray, label: np.ndarray, sketches: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by key, label and time, the place of the row whose sketch stands for theirs: the earliest of the same
    key and label that is within the distance and stands for itself."""
    of = np.arange(len(key))
    first = _first_of_runs(key, label)
    size = np.diff(np.append(first, len(key)))
    left = np.flatnonzero(np.repeat(size > 1, size))
    while len(left):
        first = _first_of_runs(key[left], label[left])
        head = np.repeat(left[first], np.diff(np.append(first, len(left))))
        near = np.bitwise_count(sketches[left] ^ sketches[head]) <= distance
        of[left[near]] = head[near]
        left = left[~near]
    return of


def _entry(wide: bool) -> np.dtype:
    """A row of a bucket: what is left of its key, its id, the minute from which and the hours over which its like stand, its
    sketch."""
    return np.dtype([("key", "<u4"), ("id", "<i8" if wide else "<u4"), ("low", "<i4"), ("hours", "<u2"), ("sketch", "<u8")])


_BANDED = "part int, wide boolean, entries binary, a array<long>, b array<long>"


def _banded(dim: int, bands: range, parts: int, similarity: float, limit: int, distance: int):
    """Packed rows of the buckets of some bands, by part; and, with a part of -1 - x, the ids of records (a) with their labels (b)."""
    schema = pa.schema([("part", pa.int32()), ("wide", pa.bool_()), ("entries", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(dim, bands)
        held: list[tuple] = []

        def chunk() -> Iterator[pa.RecordBatch]:
            ids, t, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            x = unit_rows(x).astype(np.float32)
            keys, sketches = sign(x)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            by_time = np.argsort(t, kind="stable")
            for key in keys[:LABELLING]:
                order = by_time[np.argsort(key[by_time], kind="stable")]
                for d in (1, 2):
                    i, j = order[:-d], order[d:]
                    near = (key[i] == key[j]) & (t[j] - t[i] <= limit)
                    i, j = i[near], j[near]
                    for at in range(0, len(i), 65_536):
                        p, q = i[at : at + 65_536], j[at : at + 65_536]
                        alike = np.einsum("ij,ij->i", x[p], x[q]) >= similarity
                        a.append(p[alike])
                        b.append(q[alike])
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            label = label_components(len(ids), rank[np.concatenate(a)], rank[np.concatenate(b)])[rank]
            own = label != rank
            by_label = np.lexsort((t, label))
            wide = bool(len(ids)) and not (0 <= ids.min() and ids.max() < 2**32)
            low, kind = np.clip(t // MINUTE, -(2**31), 2**31 - 1), _entry(wide)
            made, to = [], []
            for key, sketch in zip(keys, sketches):
                order = by_label[np.argsort(key[by_label], kind="stable")]
                of = _neighbourhoods(key[order], label[order], sketch[order], distance)
                high = t[order].copy()
                np.maximum.at(high, of, t[order])
                first = np.flatnonzero(of == np.arange(len(of)))
                at = order[first]
                e = np.empty(len(first), kind)
                e["key"], e["id"], e["low"], e["sketch"] = key[at] >> np.uint64(32), ids[at], low[at], sketch[at]
                e["hours"] = np.minimum(-(-(high[first] - t[at]) // HOUR), 65_535)
                made.append(e)
                to.append((key[at] % np.uint64(parts)).astype(np.int32))
            made, to = np.concatenate(made), np.concatenate(to)
            order = np.argsort(to, kind="stable")
            made, to = made[order], to[order]
            first = _first_of_runs(to)
            ends = np.append(first[1:], len(to))
            some = [(int(to[f]), wide, made[f:g].tobytes(), [], []) for f, g in zip(first, ends)]
            some.append((-1 - int(ids[0]) % parts, wide, b"", ids[own], ids[by_id][label[own]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], f.type) for c, f in enumerate(schema)], schema=schema)

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), unpacked(batch.column(2), dim)))
                count += batch.num_rows
            if count >= CHUNK:
                yield from chunk()
                count = 0
        if held:
            yield from chunk()

    return banded


def _compared(key: np.ndarray, e: np.ndarray, distance: int, minutes: int, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids, of a minimum spanning forest by distance of sketches, of rows that are of one key, near in time and by
    sketch. Rows in order of key and low; second: only pairs of a row for which it is false with one for which it is true."""
    low, ids, sketch = e["low"].astype(np.int64), np.ascontiguousarray(e["id"]), np.ascontiguousarray(e["sketch"])
    high = np.where(e["hours"] == 65_535, 2**40, low + e["hours"].astype(np.int64) * 60) + minutes
    end = np.append(_first_of_runs(key)[1:], len(key)) if len(key) else key
    end = np.repeat(end, np.diff(np.append(0, end)))
    active, d, many = np.arange(len(key)), 0, 0
    found: list[tuple] = [(ids[:0], ids[:0], np.zeros(0, np.uint8))]

    def thinned() -> None:
        a, b, w = (np.concatenate(c) for c in zip(*found))
        keep = spanning_forest(a, b, w)
        found[:] = [(a[keep], b[keep], w[keep])]

    while len(active):
        d += 1
        active = active[active + d < end[active]]
        # In order of the earlier time: once too late, every later row of the bucket is too.
        active = active[low[active + d] <= high[active]]
        other = active + d
        apart = np.bitwise_count(sketch[active] ^ sketch[other])
        near = (apart <= distance) & (ids[active] != ids[other])
        if second is not None:
            near &= second[active] != second[other]
        i, j = active[near], other[near]
        found.append((ids[i], ids[j], apart[near]))
        many += len(i)
        if many > 2_000_000:
            thinned()
            many = len(found[0][0])
            many = 0 if many > 1_000_000 else many
    thinned()
    return found[0][:2]


_PAIRS = "a long, b long, sure boolean, key long, side int, block int, other int, entries binary"


def _forest(limit: int, distance: int):
    """Of packed buckets: the candidate pairs of a minimum spanning forest per batch, labels as sure pairs, and the rows of hot
    buckets, block by block, for a second pass."""
    minutes = limit // MINUTE + 2
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_()), ("key", pa.int64()), ("side", pa.int32()), ("block", pa.int32()), ("other", pa.int32()), ("entries", pa.binary())])

    def pairs(a, b, sure) -> pa.RecordBatch:
        n = len(a)
        none = [pa.nulls(n, f.type) for f in list(schema)[3:]]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(n, sure)), *none], schema=schema)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 1, 256):
            part, wide, packed, a, b = (c.to_pylist() if k < 3 else c for k, c in enumerate(columns))
            if len(a.flatten()):
                yield pairs(a.flatten(), b.flatten(), True)
            # A part's number stands before what is left of its keys.
            rows = [(p, w, np.frombuffer(e, _entry(w))) for p, w, e in zip(part, wide, packed) if p >= 0 and e]
            if not rows:
                continue
            e = np.concatenate([r.astype(_entry(True)) for _, _, r in rows])
            key = e["key"].astype(np.int64) | (np.repeat([p for p, _, _ in rows], [len(r) for _, _, r in rows]).astype(np.int64) << 32)
            order = np.lexsort((e["low"], key))
            key, e = key[order], e[order]
            first = _first_of_runs(key)
            size = np.diff(np.append(first, len(key)))
            hot = np.repeat(size > HOT, size)
            for at, n in zip(first[size > HOT], size[size > HOT]):
                blocks = -(-int(n) // HOT)
                for i in range(blocks):
                    mine = e[at + i * HOT : at + min((i + 1) * HOT, n)].tobytes()
                    for x in range(blocks):
                        yield pa.RecordBatch.from_pylist([dict(key=int(key[at]), side=int(x < i), block=min(i, x), other=max(i, x), entries=mine)], schema=schema)
            key, e = key[~hot], e[~hot]
            yield pairs(*_compared(key, e, distance, minutes), False)

    return forest


def _hot_forest(limit: int, distance: int):
    """The candidate pairs of every two blocks of a hot bucket."""
    minutes = limit // MINUTE + 2

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 3, 1):
            key, block, other, side, packed = (c.to_pylist() for c in columns)
            start = _first_of_runs(np.array(key), np.array(block), np.array(other))
            for at, to in zip(start, np.append(start[1:], len(key))):
                rows = [np.frombuffer(p, _entry(True)) for p in packed[at:to]]
                e = np.concatenate(rows)
                second = np.repeat(np.array(side[at:to]) == 1, [len(r) for r in rows])
                order = np.argsort(e["low"], kind="stable")
                e, second = e[order], second[order]
                a, b = _compared(np.zeros(len(e), np.int64), e, distance, minutes, second if block[at] != other[at] else None)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return forest


def _set_rows(dim: int):
    """`id` and the set of each usable vector, as bytes of sorted 16-bit tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(dim)
        for batch in batches:
            if batch.num_rows:
                x, out = unit_rows(unpacked(batch.column(1), dim)).astype(np.float32), []
                for at in range(0, len(x), 8192):
                    t = sign.sets(x[at : at + 8192])[0] + (np.arange(GROUPS, dtype=np.int16) * (2 * PROJECTIONS))[:, None, None]
                    out.append(np.sort(t.reshape(GROUPS * TOKENS, -1).T, axis=1))
                packed = np.ascontiguousarray(np.vstack(out)).astype("<i2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "tokens"]
                )

    return rows


def _jaccard(least: float):
    """Of rows (a, b, set of a, set of b): the pairs whose Jaccard similarity is at least so much."""
    shared = 2 * GROUPS * TOKENS * least / (1 + least)  # of two sets of equal size

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i2").reshape(n, -1) for c in (2, 3))
            both = np.sort(np.hstack([x, y]), axis=1)
            ok = (both[:, 1:] == both[:, :-1]).sum(1) >= shared
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return check


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Sorted batches regrouped so that no group (equal in the first `keys` columns) is cut."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        start = 0
        for c in range(keys):
            column = table.column(c).to_numpy()
            differs = np.flatnonzero(column != column[-1])
            start = max(start, differs[-1] + 1 if len(differs) else 0)
        if start:
            yield [table.column(c).slice(0, start).combine_chunks() for c in range(table.num_columns)]
            held = table.slice(start).to_batches()
            count = n - start
    if held:
        table = pa.Table.from_batches(held)
        yield [table.column(c).combine_chunks() for c in range(table.num_columns)]


def _alike(x: np.ndarray, t: np.ndarray, y: np.ndarray, u: np.ndarray, similarity: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    s = x @ y.T
    return s, (s >= similarity) & (np.abs(t[:, None] - u[None, :]) <= limit)


def medoids(alike: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The medoid (as an index) of each record, given who is alike (everyone to itself) by the rule of the module."""
    n = len(ids)
    order = np.lexsort((ids, -alike.sum(1)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out, left = np.full(n, -1), np.arange(n)
    while len(left):
        best = np.where(alike[np.ix_(left, left)], rank[left][None, :], n).min(1)
        is_medoid = best == rank[left]
        joins = np.isin(best, best[is_medoid])
        out[left[joins]] = order[best[joins]]
        left = left[~joins]
    return out


_VERIFIED = "id long, comp long, degree long, print long, low long, likeness double, medoid long"


def _verifier(dim: int, similarity: float, limit: int):
    """Units (comp, i, j) of rows (side, id, t, v): each record's part in it. A unit with i = j compares one block with
    itself; one with i < j compares two. The print of a record is the XOR of the hashes of those alike to it and its own."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 3, 8_192):
            comp, i, j, side, whole, ids, t = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in columns[:7])
            x = unit_rows(unpacked(columns[7], dim))
            hashed = _mixed(ids.view(np.uint64))
            n = len(ids)
            degree, prints, low, total = np.zeros(n, np.int64), np.zeros(n, np.uint64), ids.copy(), np.zeros(n)
            medoid = np.full(n, -1, np.int64)
            start = _first_of_runs(comp, i, j)
            for a, b in zip(start, np.append(start[1:], n)):
                r = slice(a, b)
                if i[a] == j[a]:
                    s, alike = _alike(x[r], t[r], x[r], t[r], similarity, limit)
                    np.fill_diagonal(alike, True)
                    degree[r] = alike.sum(1) - 1
                    prints[r] = np.bitwise_xor.reduce(np.where(alike, hashed[r][None, :], np.uint64(0)), axis=1)
                    low[r] = np.where(alike, ids[r][None, :], np.iinfo(np.int64).max).min(1)
                    total[r] = np.where(alike, s, 0).sum(1) - 1
                    if whole[a]:
                        medoid[r] = ids[r][medoids(alike, ids[r])]
                else:
                    p, q = np.flatnonzero(side[r] == 0) + a, np.flatnonzero(side[r] == 1) + a
                    s, alike = _alike(x[p], t[p], x[q], t[q], similarity, limit)
                    for one, two, m, sim in ((p, q, alike, s), (q, p, alike.T, s.T)):
                        degree[one] = m.sum(1)
                        prints[one] = np.bitwise_xor.reduce(np.where(m, hashed[two][None, :], np.uint64(0)), axis=1)
                        low[one] = np.minimum(ids[one], np.where(m, ids[two][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
                        total[one] = np.where(m, sim, 0).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(comp), pa.array(degree), pa.array(prints.view(np.int64)), pa.array(low), pa.array(total), pa.array(medoid, mask=medoid < 0)],
                names=["id", "comp", "degree", "print", "low", "likeness", "medoid"],
            )

    return verify


_UNIT = ["comp", "i", "j"]


def _units(small: DataFrame | None, large: DataFrame | None, limit: int, block: int) -> DataFrame:
    """Rows (comp, id, t, v), dealt to every unit they take part in. small components are a unit each; large ones are cut into
    slices of time no shorter than the limit, and these into blocks, so that only blocks of a slice and the next can hold
    records near in time."""
    out = [] if small is None else [small.select("comp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "id", "t", "v")]
    if large is not None:
        many, width = 1 << 24, max(limit, LEAST_SLICE)
        sliced = large.withColumn("_s", F.floor(F.col("t") / F.lit(width)).cast("long"))
        slices = materialize(sliced.groupBy("comp", "_s").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), "slices")
        near = slices.select(F.col("comp").alias("_c"), F.col("_s").alias("_to"), F.col("_blocks").alias("_there"))
        # One pass over the wide rows: every slice knows its blocks and those beside it, three short lists of numbers.
        beside = slices.join(near, (F.col("comp") == F.col("_c")) & F.col("_to").between(F.col("_s") - 1, F.col("_s") + 1))
        beside = beside.groupBy("comp", "_s", "_blocks").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("_there") - 1), lambda k: F.col("_to") * many + k))).alias("_others"))
        own = F.col("_s") * many + F.pmod(F.xxhash64("id"), F.col("_blocks"))
        dealt = sliced.join(beside, ["comp", "_s"]).withColumn("_own", own).withColumn("_x", F.explode("_others"))
        out.append(
            dealt.select(
                "comp", F.least("_own", "_x").alias("i"), F.greatest("_own", "_x").alias("j"), F.when(F.col("_own") <= F.col("_x"), 0).otherwise(1).alias("side"),
                F.lit(False).alias("whole"), "id", "t", "v", *(c for c in large.columns if c not in ("comp", "id", "t", "v")),
            )
        )
    units = reduce(DataFrame.unionByName, out)
    return units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)


def _best_neighbour(dim: int, similarity: float, limit: int):
    """Of each record in units that also carry degrees: the best (degree, then smaller id) of those alike, itself included."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 3, 8_192):
            comp, i, j, side, _, ids, t = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in columns[:7])
            x, degree = unit_rows(unpacked(columns[7], dim)), np.asarray(columns[8])
            n = len(ids)
            order = np.lexsort((ids, -degree))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            found = rank.copy()
            start = _first_of_runs(comp, i, j)
            for a, b in zip(start, np.append(start[1:], n)):
                p = np.arange(a, b) if i[a] == j[a] else np.flatnonzero(side[a:b] == 0) + a
                q = p if i[a] == j[a] else np.flatnonzero(side[a:b] == 1) + a
                if len(p) and len(q):
                    alike = _alike(x[p], t[p], x[q], t[q], similarity, limit)[1]
                    found[p] = np.minimum(found[p], np.where(alike, rank[q][None, :], n).min(1))
                    found[q] = np.minimum(found[q], np.where(alike, rank[p][:, None], n).min(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree[order[found]]), pa.array(ids[order[found]])], names=["id", "d", "best"])

    return best


def _split_large(large: DataFrame, verified: DataFrame, dim: int, similarity: float, limit: int, block: int) -> DataFrame:
    """The medoids of components of several blocks: the rule of the module, a round over all tasks at a time."""
    left, done = materialize(verified.where("medoid is null").select("id", "degree"), "left"), None
    while left.count():
        units = _units(None, large.join(left, "id"), limit, block)
        best = units.mapInArrow(_best_neighbour(dim, similarity, limit), "id long, d long, best long").groupBy("id").agg(F.max(F.struct("d", -F.col("best"))).alias("_m"))
        best = materialize(best.select("id", (-F.col("_m.col2")).alias("best")), "best")
        heads = best.where("id = best").select(F.col("best").alias("_head"))
        joined = materialize(best.join(heads, F.col("best") == F.col("_head"), "left_semi").select("id", F.col("best").alias("medoid")), "joined")
        done = joined if done is None else done.unionByName(joined)
        left = materialize(left.join(joined, "id", "left_anti"), "left")
    return done


def candidate_pairs(slim: DataFrame, similarity: float, limit: int, dim: int) -> DataFrame:
    """Pairs (a, b) of ids among which every chain of alike records is connected: those of labels (exact) and those of buckets
    that their Jaccard similarity verifies. slim: `id long`, `t long` (microseconds), `v` (packed)."""
    miss = math.acos(similarity) / math.pi
    distance = min(64, round(64 * miss + SKETCH_DEVIATIONS * math.sqrt(64 * miss * (1 - miss))))
    tasks = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sure, maybe = [], []
    for start in range(0, BANDS, ROUND):
        bands = range(start, min(start + ROUND, BANDS))
        # Nothing may go on referring to a round's plan, or its shuffle stays.
        found = materialize(
            slim.mapInArrow(_banded(dim, bands, tasks * PARTS_PER_TASK, similarity, limit, distance), _BANDED)
            .repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_forest(limit, distance), _PAIRS), "candidates"
        )
        hot = found.where("key is not null").select("key", "block", "other", "side", "entries")
        if hot.limit(1).count():
            units = hot.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
            maybe.append(materialize(units.mapInArrow(_hot_forest(limit, distance), "a long, b long"), "hot"))
        sure.append(found.where("sure").select("a", "b"))
        maybe.append(found.where("not sure").select("a", "b"))
    pairs = reduce(DataFrame.unionAll, maybe).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = slim.select("id", "v").mapInArrow(_set_rows(dim), "id long, tokens binary")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("_y")), "b")
    alike = both.select("a", "b", "_x", "_y").mapInArrow(_jaccard(least_jaccard(similarity)), "a long, b long")
    return materialize(reduce(DataFrame.unionAll, [*sure, alike]), "edges")


def verified_records(
    records: DataFrame, row_id: str, time: str, vector: str, min_similarity: float, max_days: float, dim: int, block: int = BLOCK, lone: bool = True
) -> DataFrame:
    """Each record with its `degree` (how many are alike to it), `print` (of itself and those), `low` (the least id among
    them), `likeness` (mean cosine to them) and `medoid`; two are alike if their cosine is at least `min_similarity` and
    their times at most `max_days` apart. Records without an id, a time or a usable vector are left out; so are those
    alike to none and near none, unless `lone`."""
    limit = round(max_days * 86_400_000_000)
    slim = records.select(F.col(row_id).cast("long").alias("id"), micros(time).alias("t"), F.col(vector).cast("array<float>").alias("v")).where(
        "id is not null and t is not null and v is not null"
    )
    slim = materialize(packed_vectors(slim, dim), "vectors", compression="zstd")  # read once a round and three times after
    roots = connected_components(candidate_pairs(slim, min_similarity, limit, dim))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).select("root", (F.col("_n") > block).alias("large"))
    placed = materialize(roots.join(sizes, "root").select(F.col("node").alias("_id"), F.col("root").alias("comp"), "large"), "placed")
    n, cut = placed.agg(F.count(F.lit(1)), F.max("large")).first()
    if n <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    grouped = slim.join(placed, F.col("id") == F.col("_id")).select("comp", "large", "id", "t", "v")
    large = materialize(grouped.where("large").drop("large"), "large") if cut else None
    verified = _units(grouped.where("not large").drop("large"), large, limit, block).mapInArrow(_verifier(dim, min_similarity, limit), _VERIFIED)
    verified = verified.groupBy("id").agg(
        F.first("comp").alias("comp"), F.sum("degree").alias("degree"), F.bit_xor("print").alias("print"), F.min("low").alias("low"),
        F.sum("likeness").alias("_total"), F.max("medoid").alias("medoid"),
    )
    verified = materialize(verified, "verified")
    if cut:
        split = materialize(_split_large(large, verified, dim, min_similarity, limit, block), "split")
        verified = verified.join(split.withColumnRenamed("medoid", "_m"), "id", "left").withColumn("medoid", F.coalesce("medoid", "_m")).drop("_m")
    verified = verified.withColumn("likeness", F.when(F.col("degree") > 0, F.col("_total") / F.col("degree"))).drop("_total")
    if not lone:
        return verified
    alone = slim.select("id").join(roots.select(F.col("node").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    alone = alone.select(
        "id", F.col("id").alias("comp"), F.lit(0).cast("long").alias("degree"), F.col("id").alias("print"), F.col("id").alias("low"),
        F.col("id").alias("medoid"), F.lit(None).cast("double").alias("likeness"),
    )
    return verified.unionByName(alone)


def complete_clusters(verified: DataFrame, least: int) -> DataFrame:
    """`cluster_id` (the least id) and `id` of clusters in which all are alike and nobody outside is like a member.

    least: two or more. Records belong to such a cluster exactly if as many records as they have in their closed neighbourhood share it.
    """
    key = ["low", "print", "degree"]
    whole = verified.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") == F.col("degree") + 1) & (F.col("_n") >= least)).drop("_n")
    return verified.join(whole, key).select(F.col("low").alias("cluster_id"), "id")


def medoid_clusters(verified: DataFrame, typical: int = 3) -> DataFrame:
    """One row per record: `id`, `cluster_id` (its medoid), `size`, `typical` (the cluster's members of highest degree, then
    highest likeness to nine places, then smallest id, at most so many)."""
    order = Window.partitionBy("medoid").orderBy(F.desc("degree"), F.round("likeness", 9).desc_nulls_last(), "id")
    top = verified.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= typical)
    top = top.groupBy("medoid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"]).alias("typical"))
    size = verified.groupBy("medoid").agg(F.count(F.lit(1)).alias("size"))
    return verified.join(size, "medoid").join(top, "medoid").select("id", F.col("medoid").alias("cluster_id"), "size", "typical")


def similarity_clusters(records: DataFrame, row_id: str, time: str, vector: str, min_similarity: float, max_days: float, dim: int, typical: int = 3) -> DataFrame:
    """Every record with the cluster it belongs to: `id`, `cluster_id`, `size`, `typical`.

    Defined results: records without an id, a time or a usable vector (`dim` components, none null, not all zero) are left
    out; a record unlike all others is a cluster of its own; copies are alike as others are; an empty table gives no
    rows; other columns are ignored. Ids must be unique.
    """
    return medoid_clusters(verified_records(records, row_id, time, vector, min_similarity, max_days, dim), typical)
