"""Albums: candidates, episodes, bursts, de-duplication, quota, pages.

The candidates are sorted once by time over all tasks, so a day that holds a third of all photos is cut wherever a range of
rows ends. Each task marks where episodes and bursts begin and numbers them within its range; one row per range tells how
far the numbers of the next one are ahead. The result is written once, with its vectors. Bursts of one photo pass by the
de-duplication, and from there on photos are dealt by some episodes at a time, which quota and pages both use. Only one
burst, and only one episode, is folded in one task, for their rules depend on order.

Defined results: photos without a date are left out; null flags count as false, null scores as 0, null tags as none; ties
of date are ordered by id; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotoloom.config import DEFAULTS, CurationConfig
from fotoloom.functions.naming import theme
from fotoloom.functions.tags import catalog_tags, excluded, mentions, primary_tag
from fotoloom.functions.times import micros
from fotoloom.functions.vectors import catalog_vector
from fotoloom.scratch import materialize

EPISODE = ("taken_date", "episode")


def _false(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def album_candidates(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """Analyzed and sharp, or favorite; never with an excluded tag. Tags and vectors as the catalog keeps them."""
    sharp = F.coalesce("sharpness_score", F.lit(0.0))
    return (
        photos.where(F.col("date_taken").isNotNull())
        .withColumn("tags", catalog_tags("tags"))
        .where(((_false("is_analyzed") & (sharp > cfg.min_sharpness)) | _false("is_favorite")) & ~excluded("tags"))
        .withColumn("sharpness_score", sharp)
        .withColumn("face_count", F.coalesce("face_count", F.lit(0)))
        .withColumn("is_favorite", _false("is_favorite"))
        .withColumn("feature_vector", catalog_vector("feature_vector"))
    )


def photo_score(cfg: CurationConfig = DEFAULTS) -> Column:
    bonus = lambda weight, *parts: F.when(mentions("tags", *parts), F.lit(weight)).otherwise(0.0)
    return (
        F.col("sharpness_score") + cfg.score_face * F.col("face_count") + F.when(F.col("is_favorite"), F.lit(cfg.score_favorite)).otherwise(0.0)
        + bonus(cfg.score_landscape, "Landscape") + bonus(cfg.score_architecture, "Architecture", "Landmark") + bonus(cfg.score_sunset, "Sunset", "Beach")
    )


#: Episodes that one call of a fold receives at most; fewer calls, same results.
EPISODES_PER_CALL = 64


def _linked_similarity(v: pa.Array, before) -> tuple[np.ndarray, object]:
    """Cosine of each vector with the one before it (the last one of the batch before for the first), over the shorter
    length; NaN where one of them is null, and 0 where it is empty or zero."""
    n = len(v)
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    offsets = np.asarray(v.offsets)
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok, size = np.asarray(v.is_valid()), np.diff(offsets)
    own = [flat[offsets[0] : offsets[0] + size[0]] if ok[0] else None, flat[offsets[n - 1] : offsets[n - 1] + size[n - 1]] if ok[n - 1] else None]
    out = np.full(n, np.nan)
    out[0] = _pair(before, own[0]) if before is not None and own[0] is not None else np.nan
    if n > 1 and ok.all() and (size == size[0]).all() and size[0] and offsets[n - 1] - offsets[0] == (n - 1) * size[0]:
        m = flat[offsets[0] : offsets[n]].reshape(n, -1)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        both = norm[1:] * norm[:-1]
        out[1:] = np.where(both > 0, np.einsum("ij,ij->i", m[1:], m[:-1]) / np.where(both > 0, both, 1), 0.0)
    else:
        for k in range(1, n):
            if ok[k] and ok[k - 1]:
                out[k] = _pair(flat[offsets[k - 1] : offsets[k]], flat[offsets[k] : offsets[k + 1]])
    return out, own[1]


def _pair(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    x, y = np.asarray(a[:n], np.float64), np.asarray(b[:n], np.float64)
    norm = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(x @ y / norm) if norm > 0 else 0.0


_LINKS = "_block int, _episode int, _burst int, _same_day boolean, _same_episode boolean, _several boolean, _end int, _edge array<float>"


def _linker(columns: list[str], gap: int, similarity: float, window: int):
    """Adds to each row of a range, in order: its episode and burst, counted within the range, and whether these may go on from
    the range before (`_same_day`, `_same_episode`), whether its burst may hold several. `_end` is -1 for the first row of
    the range, 1 for a repetition of the last, which carry their vectors (`_edge`), else 0."""
    day, at, vector = columns.index("taken_date"), columns.index("_t"), columns.index("feature_vector")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = TaskContext.get().partitionId(), None
        days = episode = burst = 0
        previous, whole_day, whole_episode = None, True, True

        def extended(b: pa.RecordBatch, made: dict, end: np.ndarray, edge: list) -> pa.RecordBatch:
            n = b.num_rows
            more = [
                pa.array(np.full(n, block, np.int32)), pa.array(made["episode"], pa.int32()), pa.array(made["burst"], pa.int32()), pa.array(made["same_day"]),
                pa.array(made["same_episode"]), pa.array(made["several"]), pa.array(end, pa.int32()), pa.array(edge, pa.list_(pa.float32())),
            ]
            return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*columns, *(c.split()[0] for c in _LINKS.split(", "))])

        held = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            d, t = np.asarray(b.column(day).cast(pa.int32())), np.asarray(b.column(at))
            s, after = _linked_similarity(b.column(vector), previous)
            first = last is None
            d0, t0 = (d[0], t[0]) if first else last
            new_day = np.append(d[:1], d)[1:] != np.append([d0], d[:-1])
            wait = t - np.append([t0], t[:-1])
            fresh = new_day | (wait > gap) | (s < similarity)
            shot = fresh | (wait > window)
            if first:
                fresh[0] = shot[0] = new_day[0] = False  # whether they are is told by the range before
            made = {k: np.empty(n, t_) for k, t_ in (("episode", np.int64), ("burst", np.int64), ("same_day", bool), ("same_episode", bool))}
            # Running counts that start anew with each day, and with each episode.
            seg = np.cumsum(new_day)
            total = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(new_day, total - 1, -1))
            made["episode"] = np.where(seg > 0, total - np.maximum(start, 0), episode + total)
            hits = np.cumsum(shot)
            begun = np.maximum.accumulate(np.where(fresh, hits - 1, -1))
            made["burst"] = np.where(total > 0, hits - np.maximum(begun, 0), burst + hits)
            made["same_day"] = whole_day & (seg == 0)
            made["same_episode"] = whole_episode & (total == 0)
            several = np.ones(n, bool)
            several[:-1] = ~(shot[:-1] & shot[1:])  # the last of a batch may go on
            made["several"] = several | ((np.arange(n) == 0) & first)
            episode, burst = int(made["episode"][-1]), int(made["burst"][-1])
            whole_day, whole_episode = bool(made["same_day"][-1]), bool(made["same_episode"][-1])
            last, previous = (d[-1], t[-1]), after
            end, edge = np.zeros(n, np.int32), [None] * n
            if first:
                end[0], edge[0] = -1, b.column(vector)[0].as_py()
            yield extended(b, made, end, edge)
            held = (b.slice(n - 1, 1), {k: v[-1:] for k, v in made.items()})
        if held:
            yield extended(held[0], held[1], np.ones(1, np.int32), [held[0].column(vector)[0].as_py()])

    return link


def episodes(candidates: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """Adds `taken_date`, `episode` (from 1 within the date): a new one starts after a gap of more than six hours or where
    a photo is unlike the one before (both with vectors); and for `bursts`, `_burst` and `_several`."""
    gap, window = round(cfg.episode_gap_hours * 3_600_000_000), round(cfg.burst_window_seconds * 1_000_000)
    dated = candidates.withColumn("taken_date", F.to_date("date_taken")).withColumn("_t", micros("date_taken"))
    ranged = dated.repartitionByRange("date_taken", "id").sortWithinPartitions("date_taken", "id")
    schema = T.StructType([*ranged.schema.fields, *T.StructType.fromDDL(_LINKS).fields])
    linked = materialize(ranged.mapInArrow(_linker(ranged.columns, gap, cfg.episode_min_similarity, window), schema), "links")
    # Two rows per range, however many photos there are: how far its first day and its first episode are ahead.
    ends = linked.where("_end <> 0").select("_block", "_end", "taken_date", "_t", "_episode", "_burst", "_same_day", "_same_episode", "_edge").orderBy("_block", "_end").collect()
    ahead, before = [], None
    for first, last in zip(ends[::2], ends[1::2]):
        more_episodes = more_bursts = 1
        if before is not None and before[0].taken_date == first.taken_date:
            end, e, b = before
            a, c = end._edge, first._edge
            unlike = a is not None and c is not None and _pair(np.array(a), np.array(c)) < cfg.episode_min_similarity
            if first._t - end._t > gap or unlike:
                more_episodes = e + 1
            else:
                more_episodes, more_bursts = e, b + (first._t - end._t > window)
        ahead.append((first._block, more_episodes, more_bursts))
        before = (last, last._episode + (more_episodes if last._same_day else 0), last._burst + (more_bursts if last._same_episode else 0))
    offsets = F.broadcast(candidates.sparkSession.createDataFrame(ahead, "_block int, _e int, _b int"))
    return (
        linked.where("_end < 1").join(offsets, "_block")
        .withColumn("episode", (F.col("_episode") + F.when(F.col("_same_day"), F.col("_e")).otherwise(0)).cast("int"))
        .withColumn("_burst", (F.col("_burst") + F.when(F.col("_same_episode"), F.col("_b")).otherwise(0)).cast("int"))
        .select(*dated.columns, "episode", "_burst", "_several")
    )


def bursts(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """Adds `burst` (from 1 within the episode) to what `episodes` gives: photos at most fifteen seconds after the one before."""
    return photos.withColumnRenamed("_burst", "burst")


def _direction(v) -> np.ndarray | None:
    """At length 1 in double; null for null, empty and zero vectors."""
    if v is None or not len(v):
        return None
    x = np.asarray(v, np.float64)
    n = np.sqrt(x @ x)
    return x / n if n > 0 else None


def _similarity(a: tuple, b: tuple) -> float:
    """Cosine over the shorter length of (vector, direction) pairs; 0 for null, empty or zero vectors."""
    if a[0] is None or b[0] is None or not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) == len(b[0]):
        return 0.0 if a[1] is None or b[1] is None else float(a[1] @ b[1])
    n = min(len(a[0]), len(b[0]))
    x, y = _direction(a[0][:n]), _direction(b[0][:n])
    return 0.0 if x is None or y is None else float(x @ y)


def keep_best(vectors: list, scores: list[float], similarity: float) -> list[int]:
    """The slots of a greedy pass: each photo duplicates the first retained one that it resembles and takes its slot if it
    scores higher; else it gets a slot of its own."""
    pairs = [(v, _direction(v)) for v in vectors]
    kept: list[int] = []
    for k, v in enumerate(pairs):
        for slot, r in enumerate(kept):
            if _similarity(v, pairs[r]) >= similarity:
                if scores[k] > scores[r]:
                    kept[slot] = k
                break
        else:
            kept.append(k)
    return kept


def deduplicate_bursts(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """One photo per group of near-equal ones in a burst; adds `slot`. Bursts of one pass by the fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["episode", "burst", "date_taken", "id"], kind="stable").reset_index(drop=True)
        vectors, scores = pdf["feature_vector"].tolist(), pdf["score"].tolist()
        take, slots = [], []
        for at in pdf.groupby(["episode", "burst"], sort=False).indices.values():
            kept = keep_best([vectors[k] for k in at], [scores[k] for k in at], cfg.duplicate_similarity) if len(at) > 1 else [0]
            take += [at[k] for k in kept]
            slots += range(len(kept))
        out = pdf.iloc[take].copy()
        out["slot"] = np.array(slots, np.int32)
        return out.drop(columns="_call")

    photos = photos if "_several" in photos.columns else photos.withColumn("_several", F.lit(True))
    schema = photos.withColumn("slot", F.lit(0)).schema
    folded = photos.where("_several").withColumn("_call", F.expr(f"episode div {EPISODES_PER_CALL}")).groupBy("taken_date", "_call").applyInPandas(fold, schema)
    return folded.unionByName(photos.where("not _several").withColumn("slot", F.lit(0))).drop("_several")


def within_quota(photos: DataFrame, cfg: CurationConfig = DEFAULTS, position: tuple[str, ...] = ("date_taken", "burst", "slot", "id")) -> DataFrame:
    """The best of each episode: all up to ten, else eight tenths, ten at least. Adds `rank` (by score, then position)."""
    # Dealt as the pages will be, so that these need no shuffle of their own.
    photos = photos.withColumn("_call", F.expr(f"episode div {EPISODES_PER_CALL}")).repartition("taken_date", "_call")
    episode = Window.partitionBy("taken_date", "_call", "episode")
    order = episode.orderBy(F.desc("score"), *position)
    most = F.greatest(F.lit(cfg.quota_floor), F.expr(f"(_n * {cfg.quota_tenths}) div 10"))
    return (
        photos.withColumn("_n", F.count(F.lit(1)).over(episode))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.least(F.col("_n"), most))
        .drop("_n")  # `_call` stays: the pages are dealt by it
    )


def _capacity(page: list[dict], cfg: CurationConfig) -> int:
    if not page:
        return cfg.capacity_default
    low = [[t.lower() for t in p["tags"]] for p in page]

    def says(tags, *parts):
        return any(part in t for t in tags for part in parts)

    hero = any(
        says(t, "landscape", "architecture") and p["sharpness_score"] >= cfg.hero_min_sharpness and p["face_count"] <= cfg.hero_max_faces for t, p in zip(low, page)
    )
    if hero and len(page) <= cfg.hero_max_page:
        return cfg.capacity_hero
    if any(p["face_count"] >= 2 or says(t, "food", "home", "leisure", "person") for t, p in zip(low, page)):
        return cfg.capacity_social
    return cfg.capacity_default


def paginate(photos: list[dict], cfg: CurationConfig = DEFAULTS) -> list[list[dict]]:
    """One episode's photos, in order, as pages. A photo has `kind`, `tags`, `vector`, `sharpness_score`, `face_count`."""
    for p in photos:
        p["direction"] = _direction(p["vector"])
    pages: list[list[dict]] = []
    page: list[dict] = []
    for p in photos:
        if page:
            kinds = {q["kind"] for q in page} | {p["kind"]}
            full = len(kinds) > cfg.max_kinds_per_page or len(page) >= _capacity(page, cfg)
            if not full and p["vector"] is not None and len(p["vector"]) and len(page) >= 2:
                mine = (p["vector"], p["direction"])
                sims = [_similarity(mine, (q["vector"], q["direction"])) for q in page if q["vector"] is not None]
                full = (sum(sims) / len(sims) if sims else 1.0) < cfg.page_min_similarity
            if full:
                pages.append(page)
                page = []
        page.append(p)
    if len(page) == 1 and pages and len(pages[-1]) < cfg.tail_merge_below and len({q["kind"] for q in pages[-1]} | {page[0]["kind"]}) <= cfg.max_kinds_per_page:
        pages[-1].append(page[0])
    elif page:
        pages.append(page)
    return pages


def episode_pages(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """`taken_date`, `episode`, `page_in_episode`, `photo_index` (both from 1), `photo_id`, `kind`."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["episode", "date_taken", "rank"], kind="stable").reset_index(drop=True)
        rows = [
            {"id": i, "kind": k, "tags": t, "vector": v, "sharpness_score": s, "face_count": f}
            for i, k, t, v, s, f in zip(pdf["id"], pdf["kind"], pdf["tags"], pdf["feature_vector"], pdf["sharpness_score"], pdf["face_count"])
        ]
        out = []
        for episode, at in pdf.groupby("episode", sort=False).indices.items():
            for n, page in enumerate(paginate([rows[k] for k in at], cfg), 1):
                out += [(episode, n, k, p["id"], p["kind"]) for k, p in enumerate(page, 1)]
        out = pd.DataFrame(out, columns=["episode", "page_in_episode", "photo_index", "photo_id", "kind"])
        out.insert(0, "taken_date", pdf["taken_date"].iloc[0])
        return out

    photos = photos if "_call" in photos.columns else photos.withColumn("_call", F.expr(f"episode div {EPISODES_PER_CALL}"))
    slim = photos.select(*EPISODE, "_call", "date_taken", "rank", "id", primary_tag("tags").alias("kind"), "tags", "feature_vector", "sharpness_score", "face_count")
    id_type = photos.schema["id"].dataType.simpleString()
    return slim.groupBy("taken_date", "_call").applyInPandas(fold, f"taken_date date, episode int, page_in_episode int, photo_index int, photo_id {id_type}, kind string")


def number_pages(pages: DataFrame) -> DataFrame:
    """Adds `page_number`, running on through all episodes. Only one row per date is ordered globally; within a date,
    episodes are."""
    per_episode = pages.groupBy(*EPISODE).agg(F.max("page_in_episode").alias("_n"))
    day = Window.orderBy("taken_date").rowsBetween(Window.unboundedPreceding, -1)
    before_day = per_episode.groupBy("taken_date").agg(F.sum("_n").alias("_d")).select("taken_date", F.coalesce(F.sum("_d").over(day), F.lit(0)).alias("_day"))
    episode = Window.partitionBy("taken_date").orderBy("episode").rowsBetween(Window.unboundedPreceding, -1)
    before = per_episode.select(*EPISODE, F.coalesce(F.sum("_n").over(episode), F.lit(0)).alias("_episode")).join(before_day, "taken_date")
    return pages.join(before, [*EPISODE]).withColumn("page_number", (F.col("_day") + F.col("_episode") + F.col("page_in_episode")).cast("int")).drop("_day", "_episode")


def selected_photos(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """From the catalog to the photos that go into the album, with their episode, burst, score and rank."""
    scored = album_candidates(photos, cfg).withColumn("score", photo_score(cfg))
    narrow = scored.select("id", "date_taken", "tags", "sharpness_score", "face_count", "is_favorite", "feature_vector", "score")
    return within_quota(deduplicate_bursts(bursts(episodes(narrow, cfg), cfg), cfg), cfg)


def album(photos: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """One row per photo of the album: `page_number`, `photo_index`, `photo_id`, `kind`, `taken_date`, `episode`."""
    pages = materialize(episode_pages(selected_photos(photos, cfg), cfg), "pages")  # narrow rows, read three times below
    return number_pages(pages).select("page_number", "photo_index", "photo_id", "kind", "taken_date", "episode")


def page_summary(album_rows: DataFrame) -> DataFrame:
    """Per page: `photos`, `kinds`, `theme` and the date. A page has six photos at most, so its kinds are a short list."""
    return album_rows.groupBy("page_number").agg(
        F.count(F.lit(1)).alias("photos"), F.count_distinct("kind").alias("kinds"), theme(F.collect_set("kind")).alias("theme"), F.min("taken_date").alias("taken_date")
    )
