"""The k most similar vectors for every query vector, by learned partitions.

1. A sample of at most `SAMPLE` usable vectors (those with the least id hashes) goes to the driver. Its graph of nearest
   neighbours is cut into balanced parts by recursive bisection: each half starts at the median along the leading
   direction and is improved by swapping equal numbers of nodes while that cuts fewer edges.
2. A small classifier (one hidden layer) learns, from a sampled vector, the parts in which its neighbours lie.
3. Every vector of the collection belongs to its most probable part.
4. How many parts a query must visit is measured, not guessed: `PILOTS` vectors that the classifier has not seen are compared
   with the whole collection, and the least number of parts that finds `recall` of their true neighbours is taken.
5. Queries counted to be few (`FEW_QUERIES` at most) go to the tasks that read the collection; nothing is shuffled but what
   these find. More of them meet the collection in a shuffle: each vector of the collection goes once to its part (large
   parts are cut into slices by hash), each query to the parts that it visits, whatever the number of queries.
6. What meets is reranked by exact cosine; a task keeps k of every query, and the best of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotoloom.functions.arrays import unit_rows, usable_matrix
from fotoloom.llm.packed import packed, packed_vectors, unpacked
from fotoloom.scratch import materialize

SAMPLE = 12_288
PILOTS = 192
#: Queries that are broadcast at most.
FEW_QUERIES = 1_024
MAX_PARTS = 512
ROWS_PER_PART = 24  # of the sample, at least
LEAST_PART = 96  # rows of the collection in a part, about, at least
CHUNK = 32_768
#: Vectors of the collection in a slice of a part, about: a task holds one slice at a time.
SLICE = 65_536
MARGIN = 6  # more than k are kept in single precision


@dataclass
class Partitioner:
    """A classifier from unit vectors to parts: weights of one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, rows: np.ndarray) -> np.ndarray:
        return self.scores(rows).argmax(1)


def nearest_within(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows, by blocks."""
    k, out = min(k, len(x) - 1), []
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())  # a view would hold the whole matrix
    return np.vstack(out)


def _bisect(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A balanced half of the nodes (as a mask), cutting few links."""
    sub = x[nodes]
    centred = sub - sub.mean(0)
    direction = np.ones(x.shape[1], x.dtype)
    for _ in range(12):
        direction = centred.T @ (centred @ direction)
        direction /= np.linalg.norm(direction) + 1e-12
    side = np.zeros(len(nodes), bool)
    side[np.argsort(centred @ direction, kind="stable")[len(nodes) // 2 :]] = True
    local = np.full(len(x), -1)
    local[nodes] = np.arange(len(nodes))
    near = local[links[nodes]]
    src, dst = np.repeat(np.arange(len(nodes)), near.shape[1]), near.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(rounds):
        across = np.bincount(src, side[src] != side[dst], len(nodes))
        gain = 2 * across - np.bincount(src, minlength=len(nodes))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2  # half of them, for neighbours swap places else
        if swap == 0:
            break
        side[a[:swap]], side[b[:swap]] = False, True
    return side


def balanced_parts(x: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row; parts is a power of two, and their sizes differ by one at most per level."""
    label = np.zeros(len(x), np.int64)
    step = parts // 2
    while step >= 1:
        for p in np.unique(label):
            nodes = np.flatnonzero(label == p)
            if len(nodes) > 1:
                label[nodes[_bisect(x, links, nodes)]] += step
        step //= 2
    return label


def fit(x: np.ndarray, parts: int, neighbours: int = 10, hidden: int = 128, epochs: int = 8, seed: int = 0) -> Partitioner:
    """Learn the parts of a sample of unit rows. Deterministic for the same rows in the same order."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    x = x.astype(np.float32)
    if parts < 2 or len(x) < 4:
        return Partitioner(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    links = nearest_within(x, neighbours)
    label = balanced_parts(x, links, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), links.shape[1]), label[links].ravel()), 1.0)
    target[np.arange(len(x)), label] += 2.0
    target /= target.sum(1, keepdims=True)
    w = [
        rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)).astype(np.float32) * 4, np.zeros(hidden, np.float32),
        rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32),
    ]
    m1, m2 = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0003
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Partitioner(*w)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and those as a matrix, of vectors packed (all usable) or not."""
    if pa.types.is_binary(column.type):
        return np.ones(len(column), bool), unpacked(column, dim)
    return usable_matrix(column, dim)


class _Best:
    """The best few (similarity, id) of each query so far."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.least = np.full(queries, -2.0, np.float32)
        self.parts: list[tuple] = []
        self.pending = 0
        self.queries = queries

    def add(self, q: np.ndarray, sims: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """sims: a row for each query in q, a column for each vector."""
        if sims.shape[1] > 4 * self.keep:
            cut = np.partition(sims, sims.shape[1] - self.keep, axis=1)[:, sims.shape[1] - self.keep]
            floor = np.maximum(cut, self.least[q])
        else:
            floor = self.least[q]
        i, j = np.nonzero(sims >= floor[:, None])
        if len(i):
            self.parts.append((q[i], sims[i, j], ids[j], rows[j]))
            self.pending += len(i)
            if self.pending > max(6 * self.keep * self.queries, 500_000):
                self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        q, s, i, r = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, s, i, r = q[order], s[order], i[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.keep
        q, s, i, r = q[keep], s[keep], i[keep], r[keep]
        full = place[keep] == self.keep - 1
        self.least[q[full]] = s[full]
        self.parts, self.pending = [(q, s, i, r)], len(q)


def _search(model: Partitioner, vectors: np.ndarray, own: np.ndarray, visits: np.ndarray | None, k: int, dim: int):
    """A task that finds each query's best among the rows it reads. visits: parts by queries, None for all.

    Similarities are taken in single precision first; the best k and a margin are then computed in double.
    """
    keep = k + MARGIN

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, rows, held = _Best(len(vectors), keep), [], [], 0
        double = unit_rows(vectors)
        single = double.astype(np.float32)
        every = np.arange(len(vectors))
        found: list[tuple] = []

        def flush() -> None:
            nonlocal ids, rows, held
            if not held:
                return
            x, i = np.vstack(rows), np.concatenate(ids)
            ids, rows, held = [], [], 0
            x32 = unit_rows(x).astype(np.float32)
            home = model.home(x32)
            order = np.argsort(home, kind="stable")
            ends = np.flatnonzero(np.diff(home[order])) + 1
            base = len(found)
            for group in np.split(order, ends):
                q = every if visits is None else visits[home[group[0]]]
                for at in range(0, len(q), 1024):
                    qs = q[at : at + 1024]
                    best.add(qs, single[qs] @ x32[group].T, i[group], group.astype(np.int64) + (base << 32))
            best.settle()
            # Only rows that some query keeps are remembered, with their vectors and parts.
            found.append((np.arange(len(x)), x, home))
            now = np.unique(best.parts[0][3]) if best.parts else np.zeros(0, np.int64)
            for k, (mine, v, h) in enumerate(found):
                at = np.searchsorted(mine, now[now >> 32 == k] & 0xFFFFFFFF)
                found[k] = (mine[at], v[at], h[at])

        for batch in batches:
            ok, m = _vectors(batch.column(1), dim)
            if len(m):
                ids.append(np.asarray(batch.column(0))[ok])
                rows.append(m)
                held += len(m)
            if held >= CHUNK:
                flush()
        flush()
        if best.parts and len(best.parts[0][0]):
            q, _, i, r = best.parts[0]
            sim, part = np.empty(len(q)), np.empty(len(q), np.int32)
            for base, (mine, x, home) in enumerate(found):
                here = np.flatnonzero(r >> 32 == base)
                at = np.searchsorted(mine, r[here] & 0xFFFFFFFF)
                for p in range(0, len(here), 16_384):
                    h, a = here[p : p + 16_384], at[p : p + 16_384]
                    sim[h] = np.einsum("ij,ij->i", double[q[h]], unit_rows(x[a]))
                part[here] = home[at]
            mask = i != own[q]
            yield pa.RecordBatch.from_arrays([pa.array(a[mask]) for a in (q.astype(np.int32), i, sim, part)], names=["q", "id", "sim", "part"])

    return search


_FOUND = "q int, id long, sim double, part int"


def _best_of_all(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pull(df: DataFrame, dim: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and usable vectors of a bounded number of rows; of the `most` with the least `h`, if given."""
    t = df.select("id", "v", *(["h"] if most else [])).toArrow()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    ok, m = _vectors(t.column("v").combine_chunks(), dim)
    ids = np.asarray(t.column("id"))[ok]
    if most:
        order = np.lexsort((ids, np.asarray(t.column("h"))[ok]))[:most]
        return ids[order], m[order]
    return ids, m


def train(corpus: DataFrame, dim: int, k: int, recall: float) -> tuple[Partitioner, int]:
    """The classifier, and how many parts to visit for the recall wanted. corpus: `id long`, `v` (array or packed)."""
    # The rows with the least hashes, as many as wanted and a few more to choose from: nothing else leaves the executors.
    rows = corpus.select("id").count()
    share = min(1.0, 1.2 * (SAMPLE + PILOTS) / max(1, rows))
    least = F.xxhash64("id") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    ids, x = _pull(corpus.where(least & F.col("v").isNotNull()).withColumn("h", F.xxhash64("id")), dim, SAMPLE + PILOTS)
    x = unit_rows(x) if len(x) else x
    pilots = min(PILOTS, len(ids) // 8)
    seen = x[pilots:]
    parts = 1
    while parts * 2 <= MAX_PARTS and len(seen) >= parts * 2 * ROWS_PER_PART and rows >= parts * 2 * LEAST_PART:
        parts *= 2
    model = fit(seen, parts)
    if model.parts == 1 or not pilots:
        return model, model.parts
    probe, own = x[:pilots].astype(np.float32), ids[:pilots]
    true = _best_of_all(corpus.mapInArrow(_search(model, probe, own, None, k, dim), _FOUND), k).select("q", "part").toPandas()
    rank = np.argsort(np.argsort(-model.scores(probe.astype(np.float32)), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(rank[true["q"].to_numpy(), true["part"].to_numpy()])
    if not len(needed):
        return model, model.parts
    # However they are chosen, the parts visited should hold more than k rows.
    held = np.cumsum(np.sort(np.bincount(model.home(seen.astype(np.float32)), minlength=parts))) * (rows / len(seen))
    return model, max(int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1, min(parts, int(np.searchsorted(held, 3 * (k + 1))) + 1))


def _parts(model: Partitioner, dim: int, slices: np.ndarray | None = None):
    """Rows (id, v packed) with their unit: their part, and within it a slice by hash, as `part * 65536 + slice`."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.asarray(batch.column(0)), unpacked(batch.column(1), dim)
            home = model.home(unit_rows(x).astype(np.float32))
            if slices is None:
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32))], names=["part"])
            else:
                hashed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                unit = (home << 16) + (hashed % slices[home].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(np.zeros(len(ids), np.int8)), batch.column(0), batch.column(1)], names=["unit", "kind", "id", "v"])

    return parts


def _visits(model: Partitioner, dim: int, visit: int, slices: np.ndarray):
    """Queries (id, v packed), once for each slice of each part that they visit."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = unpacked(batch.column(1), dim)
                scores = model.scores(unit_rows(x).astype(np.float32))
                chosen = np.argpartition(-scores, visit - 1, axis=1)[:, :visit] if visit < model.parts else np.tile(np.arange(model.parts), (len(x), 1))
                n = slices[chosen]
                who = np.repeat(np.arange(len(x)), n.sum(1))
                of = np.repeat(chosen.ravel(), n.ravel())
                nth = np.arange(len(of)) - np.repeat(np.cumsum(n.ravel()) - n.ravel(), n.ravel())
                unit = (of << 16) + nth
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit.astype(np.int32)), pa.array(np.ones(len(of), np.int8)), batch.column(0).take(pa.array(who)), packed(x[who])], names=["unit", "kind", "id", "v"]
                )

    return visits


def _rerank(k: int, dim: int):
    """Of rows in order of unit and kind, the vectors of a slice before the queries that visit it: each query's k best of the
    task, by exact cosine."""
    keep = k + MARGIN

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = -1, [], None
        found: list[tuple] = []
        many = 0

        def best() -> pa.RecordBatch:
            q, i, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            return pa.RecordBatch.from_arrays([pa.array(c[top]) for c in (q, i, s)], names=["q", "id", "sim"])

        for batch in batches:
            unit, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ids, x = np.asarray(batch.column(2)), unpacked(batch.column(3), dim)
            change = np.flatnonzero((unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.append(0, change), np.append(change, len(unit))):
                if a == b:
                    continue
                if unit[a] != here:
                    here, held, ready = unit[a], [], None
                if kind[a] == 0:
                    held.append((ids[a:b].copy(), x[a:b].copy()))
                    continue
                if not held:
                    continue
                if ready is None:
                    i, v = (np.concatenate(c) for c in zip(*held))
                    ready = (i, v, unit_rows(v).astype(np.float32))
                i, v, single = ready
                for at in range(a, b, 256):
                    mine, q = ids[at : min(at + 256, b)], unit_rows(x[at : min(at + 256, b)])
                    s = q.astype(np.float32) @ single.T
                    n = min(keep, s.shape[1])
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    exact = np.einsum("qd,qnd->qn", q, unit_rows(v[top.ravel()]).reshape(*top.shape, dim))
                    other = i[top] != mine[:, None]
                    found.append((np.repeat(mine, n)[other.ravel()], i[top][other], exact[other]))
                    many += int(other.sum())
                if many > 4_000_000:
                    yield best()
                    found, many = [], 0
        if found:
            yield best()

    return rerank


def _shuffled(base: DataFrame, asked: DataFrame, model: Partitioner, visit: int, k: int, dim: int) -> DataFrame:
    """Queries of any number against the collection, each vector of which is shuffled once; both `id long`, `v` packed."""
    count = np.zeros(model.parts, np.int64)
    for r in base.mapInArrow(_parts(model, dim), "part int").groupBy("part").count().collect():  # at most MAX_PARTS rows
        count[r["part"]] = r["count"]
    slices = np.maximum(1, -(-count // SLICE))
    rows = "unit int, kind byte, id long, v binary"
    met = base.mapInArrow(_parts(model, dim, slices), rows).unionAll(asked.mapInArrow(_visits(model, dim, visit, slices), rows))
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(tasks, "unit").sortWithinPartitions("unit", "kind").mapInArrow(_rerank(k, dim), "q long, id long, sim double")
    return _best_of_all(found, k).select(F.col("q").alias("query_id"), F.col("id").alias("neighbour_id"), F.col("sim").alias("similarity"), "rank")


def nearest(corpus: DataFrame, queries: DataFrame, row_id: str, vector: str, query_id: str, query_vector: str, k: int, dim: int, recall: float = 0.92) -> DataFrame:
    """`query_id`, `neighbour_id`, `similarity`, `rank`: for each query the k most similar other rows of the corpus.

    A query's own id is never its neighbour. Defined results: rows and queries without an id or a usable vector (`dim`
    components, none null, not all zero) have and are no neighbours; equal similarities are ordered by id; repeated rows
    of the corpus may each be a neighbour; a corpus of k rows or fewer gives fewer neighbours; empty tables give no rows;
    other columns are ignored. `recall` is the share of true neighbours that the pilots must find.
    """
    spark = corpus.sparkSession
    base = corpus.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<float>").alias("v")).where("id is not null and v is not null")
    zero = F.lit(0).cast("long").alias("t")
    asked = materialize(packed_vectors(asked.dropDuplicates(["id"]).select("id", zero, "v"), dim).drop("t"), "queries", compression="zstd")
    number = asked.count()
    if number > FEW_QUERIES:
        # Read four times: for the sample, the pilots, the sizes of the parts and the shuffle.
        base = materialize(packed_vectors(base.where("v is not null").select("id", zero, "v"), dim).drop("t"), "collection", compression="zstd")
        model, visit = train(base, dim, k, recall)
        return _shuffled(base, asked, model, visit, k, dim)
    empty = spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, rank int")
    if not number:
        return empty
    model, visit = train(base, dim, k, recall)
    ids, x = _pull(asked, dim)  # at most FEW_QUERIES rows
    scores = model.scores(unit_rows(x).astype(np.float32))
    chosen = np.argpartition(-scores, visit - 1, axis=1)[:, :visit] if visit < model.parts else np.tile(np.arange(model.parts), (len(x), 1))
    flat, who = chosen.ravel(), np.repeat(np.arange(len(x)), chosen.shape[1])
    order = np.argsort(flat, kind="stable")
    visits = np.split(who[order], np.searchsorted(flat[order], np.arange(1, model.parts)))
    best = _best_of_all(base.mapInArrow(_search(model, x, ids, visits, k, dim), _FOUND), k)
    names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids), dtype=np.int32), "query_id": ids}))
    return best.join(F.broadcast(names), "q").select("query_id", F.col("id").alias("neighbour_id"), F.col("sim").alias("similarity"), "rank")
