"""Queries of album generation, tagging and face detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.config import DEFAULTS, EXCLUDED_TAGS
from fotoloom.functions.tags import catalog_tags
from fotoloom.operators import album, detection, tagging
from fotoloom.plans.gallery_queries import CLEAN, VECTOR, _cosine, _without_synonyms
from fotoloom.sources.tables import spread, table


def _photos(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "photos")


def _episodes(spark, folder):
    rows = album.album_candidates(_photos(spark, folder)).withColumn("score", album.photo_score())
    return album.episodes(rows.select("id", "date_taken", "tags", "sharpness_score", "face_count", "is_favorite", "feature_vector", "score"))


def album_candidates(spark, folder):
    return album.album_candidates(_photos(spark, folder)).select("id", "date_taken", F.array_join("tags", "|").alias("tags"))


def photo_score(spark, folder):
    rows = _photos(spark, folder).withColumns(
        {"tags": catalog_tags("tags"), "sharpness_score": F.coalesce("sharpness_score", F.lit(0.0)), "face_count": F.coalesce("face_count", F.lit(0)), "is_favorite": F.coalesce("is_favorite", F.lit(False))}
    )
    return rows.select("id", F.round(album.photo_score(), 6).alias("score"))


def episodes(spark, folder):
    return _episodes(spark, folder).select("id", "taken_date", "episode")


def bursts(spark, folder):
    return album.bursts(_episodes(spark, folder)).select("id", "taken_date", "episode", "burst")


def episode_topk(spark, folder):
    """The quota applied to whole episodes, before any de-duplication."""
    return album.within_quota(_episodes(spark, folder), position=("date_taken", "id")).select("id", "taken_date", "episode", "rank")


def burst_dedup(spark, folder):
    return album.deduplicate_bursts(album.bursts(_episodes(spark, folder))).select("id", "taken_date", "episode", "burst", "slot")


def album_pages(spark, folder):
    return album.album(_photos(spark, folder))


def album_page_summary(spark, folder):
    return album.page_summary(album.album(_photos(spark, folder)))


def zero_shot_scores(spark, folder):
    found = tagging.category_scores(spread(_photos(spark, folder), "id"), table(spark, folder, "categories"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("categories"), F.round(F.max("p").cast("double"), 4).alias("best"), F.round(F.sum(F.col("p").cast("double")), 3).alias("total"))


def zero_shot_tags(spark, folder):
    found = tagging.zero_shot_tags(spread(_photos(spark, folder), "id"), table(spark, folder, "categories"))
    return found.select("id", F.array_join("tags", "|").alias("tags"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def analysis_route(spark, folder):
    return _photos(spark, folder).select("id", tagging.analysis_route().alias("route"))


def analyze_photos(spark, folder):
    found = tagging.analyze(spread(_photos(spark, folder), "id"), table(spark, folder, "categories"))
    return found.select("id", "is_analyzed", F.array_join("tags", "|").alias("tags"))


def face_nms(spark, folder):
    return detection.face_counts(table(spark, folder, "detections"))


QUERIES = {
    q.__name__: q
    for q in (
        album_candidates, photo_score, episodes, bursts, episode_topk, burst_dedup, album_pages, album_page_summary, zero_shot_scores, zero_shot_tags,
        analysis_route, analyze_photos, face_nms,
    )
}

_LOW = "list_transform(tags, lambda t: lower(t))"
_BARRED = "[" + ", ".join(f"'{t.lower()}'" for t in EXCLUDED_TAGS) + "]"


def _says(*parts: str) -> str:
    return "(" + " OR ".join(f"len(list_filter(tags, lambda t: contains(lower(t), '{p}'))) > 0" for p in parts) + ")"


_SCORE = f"""coalesce(sharpness_score, 0) + 200.0 * coalesce(face_count, 0) + CASE WHEN is_favorite THEN 2000 ELSE 0 END
  + CASE WHEN {_says("landscape")} THEN 300 ELSE 0 END + CASE WHEN {_says("architecture", "landmark")} THEN 200 ELSE 0 END
  + CASE WHEN {_says("sunset", "beach")} THEN 200 ELSE 0 END"""
_CANDIDATES = f"""
  candidates AS (SELECT * REPLACE ({VECTOR} AS feature_vector), {_SCORE} AS score FROM ({CLEAN})
    WHERE date_taken IS NOT NULL AND ((coalesce(is_analyzed, false) AND coalesce(sharpness_score, 0) > 50) OR coalesce(is_favorite, false)) AND NOT list_has_any({_LOW}, {_BARRED}))
"""
_EPISODES = f"""
WITH {_CANDIDATES},
  beside AS (SELECT *, date_taken::DATE AS taken_date, lag(date_taken) OVER w AS t0, lag(feature_vector) OVER w AS v0
    FROM candidates WINDOW w AS (PARTITION BY date_taken::DATE ORDER BY date_taken, id)),
  marked AS (SELECT *, CASE WHEN t0 IS NULL OR date_taken - t0 > INTERVAL 6 HOUR
      OR (feature_vector IS NOT NULL AND v0 IS NOT NULL AND {_cosine("feature_vector", "v0")} < 0.45) THEN 1 ELSE 0 END AS fresh FROM beside),
  episodes AS (SELECT * EXCLUDE (t0, v0, fresh), sum(fresh) OVER (PARTITION BY taken_date ORDER BY date_taken, id ROWS UNBOUNDED PRECEDING)::INTEGER AS episode FROM marked)
"""
_TAGS = """
WITH unit AS (
    SELECT id, CASE WHEN n > 0 THEN list_transform(v, lambda x: (x / n)::FLOAT) ELSE v END AS v
    FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x * x)::DOUBLE))) AS n FROM (SELECT id, {vector} AS v FROM photos)) WHERE v IS NOT NULL),
  vocabulary AS (SELECT category_idx, coalesce(list_transform(embedding, lambda x: coalesce(x, 0)::FLOAT), []) AS e FROM categories WHERE category_idx IS NOT NULL),
  scores AS (
    SELECT id, category_idx, (1 / (1 + exp(-(coalesce(list_sum(list_transform(list_zip(v[1:least(len(v), len(e))], e[1:least(len(v), len(e))]), lambda z: (z[1] * z[2])::DOUBLE)), 0)
      * exp(4.765::FLOAT::DOUBLE) + (-12.932)::FLOAT::DOUBLE))))::FLOAT AS p FROM unit, vocabulary)
""".replace("{vector}", VECTOR)
_WORDS = """
  words AS (SELECT category_idx, category_idx::BIGINT * 1000000 + i - 1 AS ord, tags[i] AS tag FROM categories, unnest(range(1, len(tags) + 1)) AS r(i)
    WHERE category_idx IS NOT NULL AND tags[i] IS NOT NULL AND tags[i] <> '' AND tags[i] <> 'Other'),
  best AS (SELECT id, arg_min(category_idx, (-p, category_idx)) AS best, max(p) AS confidence FROM scores GROUP BY id),
  passing AS (
    SELECT id, list(tag ORDER BY p DESC, ord) AS tags FROM (
      SELECT id, max(p) AS p, min(ord) AS ord, arg_min(tag, ord) AS tag FROM scores JOIN words USING (category_idx) WHERE p >= 0.2::FLOAT GROUP BY id, lower(tag)) GROUP BY id),
  spare AS (SELECT category_idx, list(tag ORDER BY ord) AS tags FROM (SELECT category_idx, min(ord) AS ord, arg_min(tag, ord) AS tag FROM words GROUP BY category_idx, lower(tag)) GROUP BY 1),
  chosen AS (SELECT p.id, coalesce(a.tags, s.tags, []) AS tags, coalesce(b.confidence, 0) AS confidence
    FROM photos p LEFT JOIN best b ON b.id = p.id LEFT JOIN passing a ON a.id = p.id LEFT JOIN spare s ON s.category_idx = b.best),
  tagged AS (SELECT id, confidence, {without} AS tags FROM chosen),
  named AS (SELECT id, confidence, CASE WHEN len(tags) > 0 THEN tags ELSE ['Other'] END AS tags FROM tagged)
""".replace("{without}", _without_synonyms())
_OVERLAP = """(least(k.x2, b.x2) > greatest(k.x1, b.x1) AND least(k.y2, b.y2) > greatest(k.y1, b.y1)
  AND (least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1))
  / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1))) > 0.4::FLOAT::DOUBLE)"""

_BURSTS = f"""{_EPISODES.replace("WITH", "WITH RECURSIVE", 1)},
  b AS (SELECT *, CASE WHEN date_taken - lag(date_taken) OVER (PARTITION BY taken_date, episode ORDER BY date_taken, id) <= INTERVAL 15 SECOND THEN 0 ELSE 1 END AS fresh FROM episodes),
  burst AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY taken_date, episode ORDER BY date_taken, id ROWS UNBOUNDED PRECEDING)::INTEGER AS burst FROM b)"""
# The fold over each burst: of the slots kept so far, the first that resembles a photo gives way to it if it scores higher.
_DEDUP = f"""{_BURSTS},
  shot AS (SELECT taken_date, episode, burst, row_number() OVER (PARTITION BY taken_date, episode, burst ORDER BY date_taken, id) AS nth,
    struct_pack(id := id, v := feature_vector, score := score) AS p FROM burst),
  fold AS (
    SELECT taken_date, episode, burst, nth, [p] AS kept FROM shot WHERE nth = 1
    UNION ALL
    SELECT taken_date, episode, burst, nth, CASE WHEN place = 0 THEN list_append(kept, p)
      WHEN p.score > kept[place].score THEN list_concat(kept[1:place - 1], [p], kept[place + 1:]) ELSE kept END
    FROM (SELECT f.taken_date, f.episode, f.burst, s.nth, f.kept, s.p,
        coalesce(list_position(list_transform(f.kept, lambda k: {_cosine("k.v", "s.p.v")} >= {DEFAULTS.duplicate_similarity}), true), 0) AS place
      FROM fold f JOIN shot s ON s.taken_date = f.taken_date AND s.episode = f.episode AND s.burst = f.burst AND s.nth = f.nth + 1)),
  last AS (SELECT taken_date, episode, burst, arg_max(kept, nth) AS kept FROM fold GROUP BY ALL),
  slots AS (SELECT taken_date, episode, burst, kept[k].id AS id, (k - 1)::INTEGER AS slot FROM last, unnest(range(1, len(kept) + 1)) AS r(k))"""
_HERO = f"{_says('landscape', 'architecture')} AND sharpness_score >= {DEFAULTS.hero_min_sharpness} AND coalesce(face_count, 0) <= {DEFAULTS.hero_max_faces}"
_SOCIAL = f"coalesce(face_count, 0) >= 2 OR {_says('food', 'home', 'leisure', 'person')}"
# The fold over each episode's photos: the state is the page that is open.
_PAGES = f"""{_DEDUP},
  ranked AS (SELECT b.*, slot, count(*) OVER e AS n, row_number() OVER (PARTITION BY b.taken_date, b.episode ORDER BY score DESC, date_taken, b.burst, slot, b.id) AS rank
    FROM burst b JOIN slots s ON s.id = b.id WINDOW e AS (PARTITION BY b.taken_date, b.episode)),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY taken_date, episode ORDER BY date_taken, rank) AS nth,
      struct_pack(id := id, v := feature_vector, kind := coalesce(tags[1], 'Other'), hero := {_HERO}, social := {_SOCIAL}) AS p
    FROM ranked WHERE rank <= least(n, greatest({DEFAULTS.quota_floor}, n * {DEFAULTS.quota_tenths} // 10))),
  laid AS (
    SELECT taken_date, episode, nth, 1 AS page, [p] AS open FROM chosen WHERE nth = 1
    UNION ALL
    SELECT taken_date, episode, nth, CASE WHEN full_up THEN page + 1 ELSE page END, CASE WHEN full_up THEN [p] ELSE list_append(open, p) END
    FROM (SELECT l.taken_date, l.episode, c.nth, l.page, l.open, c.p,
        len(list_distinct(list_append(list_transform(l.open, lambda q: q.kind), c.p.kind))) > {DEFAULTS.max_kinds_per_page}
        OR len(l.open) >= CASE WHEN len(list_filter(l.open, lambda q: q.hero)) > 0 AND len(l.open) <= {DEFAULTS.hero_max_page} THEN {DEFAULTS.capacity_hero}
          WHEN len(list_filter(l.open, lambda q: q.social)) > 0 THEN {DEFAULTS.capacity_social} ELSE {DEFAULTS.capacity_default} END
        OR (c.p.v IS NOT NULL AND len(l.open) >= 2 AND coalesce(list_avg(list_transform(list_filter(l.open, lambda q: q.v IS NOT NULL), lambda q: {_cosine("q.v", "c.p.v")})), 1.0)
          < {DEFAULTS.page_min_similarity}) AS full_up
      FROM laid l JOIN chosen c ON c.taken_date = l.taken_date AND c.episode = l.episode AND c.nth = l.nth + 1)),
  pages AS (SELECT taken_date, episode, page, arg_max(open, nth) AS open, max(page) OVER (PARTITION BY taken_date, episode) AS most FROM laid GROUP BY taken_date, episode, page),
  before AS (SELECT *, lag(open) OVER (PARTITION BY taken_date, episode ORDER BY page) AS previous FROM pages),
  tail AS (SELECT taken_date, episode, CASE WHEN len(open) = 1 AND previous IS NOT NULL AND len(previous) < {DEFAULTS.tail_merge_below}
      AND len(list_distinct(list_append(list_transform(previous, lambda q: q.kind), open[1].kind))) <= {DEFAULTS.max_kinds_per_page} THEN page END AS merged FROM before WHERE page = most),
  whole AS (SELECT p.taken_date, p.episode, CASE WHEN p.page = merged THEN p.page - 1 ELSE p.page END AS page, p.open, p.page = merged AS moved FROM pages p JOIN tail t USING (taken_date, episode)),
  items AS (SELECT taken_date, episode, page, coalesce(moved, false) AS moved, k, open[k].id AS photo_id, open[k].kind AS kind FROM whole, unnest(range(1, len(open) + 1)) AS r(k)),
  album AS (SELECT dense_rank() OVER (ORDER BY taken_date, episode, page)::INTEGER AS page_number,
      row_number() OVER (PARTITION BY taken_date, episode, page ORDER BY moved, k)::INTEGER AS photo_index, photo_id, kind, taken_date, episode FROM items)"""

SQL = {
    "burst_dedup": f"{_DEDUP} SELECT id, taken_date, episode, burst, slot FROM slots",
    "album_pages": f"{_PAGES} SELECT page_number, photo_index, photo_id, kind, taken_date, episode FROM album",
    "album_page_summary": f"""{_PAGES},
  k AS (SELECT page_number, count(*) AS photos, min(taken_date) AS taken_date FROM album GROUP BY 1),
  t AS (SELECT page_number, count(*) AS kinds, string_agg(replace(kind, ' ', '_'), '_and_' ORDER BY lower(kind), kind DESC) AS theme FROM (SELECT DISTINCT page_number, kind FROM album) GROUP BY 1)
SELECT page_number, photos, kinds, theme, taken_date FROM k JOIN t USING (page_number)""",
    "album_candidates": f"WITH {_CANDIDATES} SELECT id, date_taken, coalesce(array_to_string(tags, '|'), '') AS tags FROM candidates",
    "photo_score": f"SELECT id, round(({_SCORE})::DOUBLE, 6) AS score FROM ({CLEAN})",
    "episodes": f"{_EPISODES} SELECT id, taken_date, episode FROM episodes",
    "bursts": f"""{_EPISODES}, b AS (SELECT id, date_taken, taken_date, episode,
    CASE WHEN date_taken - lag(date_taken) OVER (PARTITION BY taken_date, episode ORDER BY date_taken, id) <= INTERVAL 15 SECOND THEN 0 ELSE 1 END AS fresh FROM episodes)
SELECT id, taken_date, episode, sum(fresh) OVER (PARTITION BY taken_date, episode ORDER BY date_taken, id ROWS UNBOUNDED PRECEDING)::INTEGER AS burst FROM b""",
    "episode_topk": f"""{_EPISODES}, r AS (SELECT *, count(*) OVER (PARTITION BY taken_date, episode) AS n,
    row_number() OVER (PARTITION BY taken_date, episode ORDER BY score DESC, date_taken, id)::INTEGER AS rank FROM episodes)
SELECT id, taken_date, episode, rank FROM r WHERE rank <= least(n, greatest(10, n * 8 // 10))""",
    "zero_shot_scores": f"{_TAGS} SELECT id, count(*) AS categories, round(max(p)::DOUBLE, 4) AS best, round(sum(p::DOUBLE), 3) AS total FROM scores GROUP BY id",
    "zero_shot_tags": f"{_TAGS}, {_WORDS} SELECT id, array_to_string(tags, '|') AS tags, round(confidence::DOUBLE, 4) AS confidence FROM named",
    "analysis_route": f"SELECT id, CASE WHEN len(tags) > 0 THEN 'tags' WHEN {VECTOR} IS NOT NULL THEN 'vector' ELSE 'image' END AS route FROM ({CLEAN})",
    "analyze_photos": f"""{_TAGS}, {_WORDS}
SELECT p.id, true AS is_analyzed, array_to_string(CASE WHEN len(p.tags) > 0 THEN p.tags
  WHEN p.face_count > 0 AND NOT list_contains(list_transform(n.tags, lambda t: lower(t)), 'person') THEN list_prepend('Person', n.tags) ELSE n.tags END, '|') AS tags
FROM ({CLEAN}) p JOIN named n ON n.id = p.id""",
    "face_nms": f"""
WITH RECURSIVE px AS (
    SELECT image_id, anchor_idx, face_score, x1::DOUBLE * 320 AS x1, y1::DOUBLE * 240 AS y1, x1::DOUBLE * 320 + greatest(x2::DOUBLE * 320 - x1::DOUBLE * 320, 0) AS x2,
      y1::DOUBLE * 240 + greatest(y2::DOUBLE * 240 - y1::DOUBLE * 240, 0) AS y2 FROM detections
    WHERE face_score > 0.65::FLOAT AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND image_id IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY face_score DESC, anchor_idx, x1, y1, x2, y2) AS nth FROM px),
  fold AS (
    SELECT image_id, 0::BIGINT AS nth, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM ranked WHERE nth = 1
    UNION ALL
    SELECT f.image_id, b.nth, CASE WHEN len(list_filter(f.kept, lambda k: {_OVERLAP})) > 0 THEN f.kept
      ELSE list_append(f.kept, struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END
    FROM fold f JOIN ranked b ON b.image_id = f.image_id AND b.nth = f.nth + 1),
  final AS (SELECT image_id, arg_max(len(kept), nth) AS faces FROM fold GROUP BY 1)
SELECT d.image_id, coalesce(f.faces, 0)::INTEGER AS faces FROM (SELECT DISTINCT image_id FROM detections WHERE image_id IS NOT NULL) d LEFT JOIN final f ON f.image_id = d.image_id""",
}
