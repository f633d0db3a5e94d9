"""Queries on the catalog and the gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotoloom.functions import tags as T
from fotoloom.functions.naming import safe_name, theme
from fotoloom.functions.times import micros
from fotoloom.functions.vectors import catalog_vector, cosine
from fotoloom.operators import catalog, gallery
from fotoloom.operators.export import album_manifest
from fotoloom.sources.files import folder_tree
from fotoloom.sources.tables import table

FOLDER = "/vault/n"  # a prefix, not a folder: it also takes in every folder whose name goes on
TARGET = "/export"


def _photos(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "photos")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "file_path", "date_taken")


def gallery_folder(spark, folder):
    return _shown(gallery.gallery(_photos(spark, folder), FOLDER))


def gallery_favorites(spark, folder):
    return _shown(gallery.gallery(_photos(spark, folder), "/", only_favorites=True))


def gallery_people(spark, folder):
    return _shown(gallery.gallery(_photos(spark, folder), "/", only_people=True)).withColumn("n", F.lit(1))


def needs_analysis(spark, folder):
    return gallery.needs_analysis(_photos(spark, folder)).select("id", "is_analyzed")


def scan_new_files(spark, folder):
    """Files of the photos table against a catalog that knows the analyzed ones."""
    photos = _photos(spark, folder)
    return gallery.new_files(photos.select("file_path"), photos.where("is_analyzed"))


_UPSERT = ("id", "file_name", "date_taken", "file_size_bytes", "is_analyzed", "sharpness_score", "face_count", "is_favorite", "tags")


def catalog_upsert(spark, folder):
    """The analyzed rows saved over the rows that are not analyzed yet."""
    photos = _photos(spark, folder)
    stored = photos.where("not is_analyzed").groupBy("file_path").agg(F.min_by(F.struct(*_UPSERT), "id").alias("r")).select("file_path", "r.*")
    found = catalog.upsert(stored, photos.where("is_analyzed").select("file_path", *_UPSERT), columns=_UPSERT)
    return found.select("file_path", "id", "file_name", "date_taken", "is_analyzed", "sharpness_score", "face_count", "is_favorite", F.array_join("tags", "|").alias("tags"))


def favorite_update(spark, folder):
    """Photos that stood in the older album become favorites."""
    photos = _photos(spark, folder)
    chosen = table(spark, folder, "album_photos").select(F.col("photo_id").alias("id")).distinct()
    updates = photos.join(chosen, "id", "left_semi").select("file_path", F.lit(True).alias("is_favorite"))
    return catalog.set_favorites(photos.select("id", "file_path", "is_favorite"), updates).select("id", "file_path", "is_favorite")


def clear_tags(spark, folder):
    """Every photo with people loses its tags."""
    found = catalog.clear_tags(_photos(spark, folder).select("id", "tags", "is_analyzed", "face_count"), "face_count > 0")
    return found.select("id", "is_analyzed", F.size(T.catalog_tags("tags")).alias("tags"))


def folders(spark, folder):
    return folder_tree(_photos(spark, folder))


def tags_display(spark, folder):
    tags = T.catalog_tags("tags")
    return _photos(spark, folder).select("id", T.primary_tag(tags).alias("primary_tag"), T.tags_display(tags).alias("display"))


def synonym_filter(spark, folder):
    return _photos(spark, folder).select("id", F.array_join(T.without_synonyms(T.catalog_tags("tags")), "|").alias("tags"))


def person_tag(spark, folder):
    return _photos(spark, folder).select("id", F.array_join(T.with_person(T.catalog_tags("tags"), "face_count"), "|").alias("tags"))


def tags_roundtrip(spark, folder):
    text = T.tags_to_text(T.catalog_tags("tags"))
    return _photos(spark, folder).select("id", text.alias("stored"), F.array_join(T.tags_from_text(text), "|").alias("tags"))


def vector_roundtrip(spark, folder):
    stored = _photos(spark, folder).select("id", T.vector_to_text(catalog_vector("feature_vector")).alias("text"))
    read = stored.select("id", T.vector_from_text("text").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read.select("id", F.coalesce(F.size("v"), F.lit(0)).alias("components"), F.round(total, 6).alias("total"))


def cosine_pairs(spark, folder):
    """Each photo beside the one before it on the same day."""
    day = Window.partitionBy(F.to_date("date_taken")).orderBy("date_taken", "id")
    rows = _photos(spark, folder).where("date_taken is not null").select("id", "date_taken", catalog_vector("feature_vector").alias("v"))
    rows = rows.select("id", "v", F.lag(F.struct("id", "v")).over(day).alias("b")).where("b is not null")
    return rows.select("id", F.col("b.id").alias("before"), F.round(cosine("v", F.col("b.v")), 6).alias("similarity"))


def export_manifest(spark, folder):
    return album_manifest(table(spark, folder, "album_photos"), _photos(spark, folder), TARGET)


def favorites_export(spark, folder):
    return gallery.favorites_manifest(_photos(spark, folder), TARGET)


def page_theme(spark, folder):
    """Pages of the older album with the theme that their photos' primary tags give them."""
    rows = table(spark, folder, "album_photos").select("page_number", F.col("photo_id").alias("id")).distinct()
    kinds = rows.join(_photos(spark, folder).select("id", T.primary_tag(T.catalog_tags("tags")).alias("kind")), "id")
    found = kinds.groupBy("page_number").agg(F.collect_set("kind").alias("k"))
    return found.select("page_number", F.size("k").alias("kinds"), theme("k").alias("theme"), safe_name(theme("k")).alias("safe_theme"))


def album_overview(spark, folder):
    """Pages of the older album: photos and the span of their dates."""
    rows = table(spark, folder, "album_photos")
    found = rows.groupBy("page_number").agg(F.count(F.lit(1)).alias("photos"), F.min("date_taken").alias("first"), F.max("date_taken").alias("last"))
    return found.select("page_number", "photos", "first", "last", ((micros("last") - micros("first")) / F.lit(1e6)).alias("seconds"))


QUERIES = {
    q.__name__: q
    for q in (
        gallery_folder, gallery_favorites, gallery_people, needs_analysis, scan_new_files, catalog_upsert, favorite_update, clear_tags, tags_display,
        synonym_filter, person_tag, tags_roundtrip, vector_roundtrip, cosine_pairs, export_manifest, favorites_export, page_theme, album_overview,
    )
} | {"folder_tree": folders}

TAGS = "list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t IS NOT NULL AND t <> '')"
CLEAN = f"SELECT * REPLACE ({TAGS} AS tags) FROM photos"
VECTOR = "CASE WHEN len(feature_vector) > 0 AND len(list_filter(feature_vector, lambda x: x IS NULL)) = 0 THEN feature_vector END"


def _cosine(a: str, b: str) -> str:
    """Over the shorter length; 0 for what has no direction."""
    n = f"least(len({a}), len({b}))"
    x, y = f"({a})[1:{n}]::DOUBLE[]", f"({b})[1:{n}]::DOUBLE[]"
    norm = f"sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product({y}, {y}))"
    return f"coalesce(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN list_inner_product({x}, {y}) / nullif({norm}, 0) END, 0)"


def _without_synonyms() -> str:
    from fotoloom.config import SYNONYMS

    low = "list_transform(tags, lambda t: lower(t))"
    gone = " OR ".join(f"(lower(t) = '{b.lower()}' AND list_contains({low}, '{a.lower()}'))" for a, b in SYNONYMS)
    return f"CASE WHEN len(tags) <= 1 THEN tags ELSE list_filter(tags, lambda t: NOT ({gone})) END"


_SAFE = r"""trim(regexp_replace({0}, '[\x00-\x1f<>:"/\\|?*]', '_', 'g'), '_')"""
SQL = {
    "gallery_folder": f"SELECT id, file_path, date_taken FROM photos WHERE starts_with(lower(file_path), '{FOLDER}') ORDER BY date_taken, id",
    "gallery_favorites": "SELECT id, file_path, date_taken FROM photos WHERE is_favorite AND file_path LIKE '/%' ORDER BY date_taken, id",
    "gallery_people": "SELECT id, file_path, date_taken, 1 AS n FROM photos WHERE face_count > 0 AND file_path LIKE '/%' ORDER BY date_taken, id",
    "needs_analysis": f"SELECT id, is_analyzed FROM ({CLEAN}) WHERE NOT coalesce(is_analyzed, false) OR len(tags) = 0",
    "scan_new_files": r"""
SELECT min(file_path) AS file_path, regexp_extract(min(file_path), '[^/\\]*$') AS file_name FROM photos p
WHERE regexp_matches(file_path, '(?i)\.(jpg|jpeg|png|heic|cr2|nef)$')
  AND NOT EXISTS (SELECT 1 FROM photos q WHERE q.is_analyzed AND lower(q.file_path) = lower(p.file_path)) GROUP BY lower(file_path)""",
    "catalog_upsert": """
WITH stored AS (SELECT * FROM photos WHERE NOT is_analyzed QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY id) = 1),
  first AS (SELECT * FROM photos WHERE is_analyzed QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY id) = 1),
  last AS (SELECT * FROM photos WHERE is_analyzed QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY id DESC) = 1)
SELECT coalesce(s.file_path, f.file_path) AS file_path, coalesce(s.id, f.id) AS id, CASE WHEN s.id IS NULL THEN f.file_name ELSE s.file_name END AS file_name,
  CASE WHEN s.id IS NULL THEN f.date_taken ELSE s.date_taken END AS date_taken, CASE WHEN l.id IS NULL THEN s.is_analyzed ELSE l.is_analyzed END AS is_analyzed,
  CASE WHEN l.id IS NULL THEN s.sharpness_score ELSE l.sharpness_score END AS sharpness_score, CASE WHEN l.id IS NULL THEN s.face_count ELSE l.face_count END AS face_count,
  CASE WHEN l.id IS NULL THEN s.is_favorite ELSE l.is_favorite END AS is_favorite,
  array_to_string(list_filter(CASE WHEN l.id IS NULL THEN s.tags ELSE l.tags END, lambda t: t IS NOT NULL), '|') AS tags
FROM stored s FULL JOIN first f ON s.file_path = f.file_path LEFT JOIN last l ON l.file_path = f.file_path""",
    "favorite_update": """
SELECT id, file_path, is_favorite OR file_path IN (SELECT file_path FROM photos WHERE id IN (SELECT photo_id FROM album_photos)) AS is_favorite FROM photos""",
    "clear_tags": f"SELECT id, is_analyzed AND NOT coalesce(face_count > 0, false) AS is_analyzed, CASE WHEN face_count > 0 THEN 0 ELSE len(tags)::INTEGER END AS tags FROM ({CLEAN})",
    "tags_display": f"SELECT id, coalesce(tags[1], 'Other') AS primary_tag, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'Untagged' END AS display FROM ({CLEAN})",
    "synonym_filter": f"SELECT id, coalesce(array_to_string({_without_synonyms()}, '|'), '') AS tags FROM ({CLEAN})",
    "person_tag": f"""SELECT id, coalesce(array_to_string(CASE WHEN face_count > 0 AND NOT list_contains(list_transform(tags, lambda t: lower(t)), 'person')
  THEN list_prepend('Person', tags) ELSE tags END, '|'), '') AS tags FROM ({CLEAN})""",
    "tags_roundtrip": f"""SELECT id, stored, coalesce(array_to_string(list_filter(list_transform(string_split(stored, ','), lambda t: trim(t)), lambda t: t <> ''), '|'), '') AS tags
FROM (SELECT id, coalesce(array_to_string(tags, ', '), '') AS stored FROM ({CLEAN}))""",
    "vector_roundtrip": f"SELECT id, coalesce(len(v), 0)::INTEGER AS components, round(list_sum(v::DOUBLE[]), 6) AS total FROM (SELECT id, {VECTOR} AS v FROM photos)",
    "cosine_pairs": f"""
WITH v AS (SELECT id, date_taken, {VECTOR} AS v FROM photos),
  b AS (SELECT id, v, lag(id) OVER w AS before, lag(v) OVER w AS u FROM v WINDOW w AS (PARTITION BY date_taken::DATE ORDER BY date_taken, id))
SELECT id, before, round({_cosine("v", "u")}, 6) AS similarity FROM b WHERE before IS NOT NULL""",
    "export_manifest": f"""
SELECT file_path AS source, '{TARGET}/Page_' || lpad(page_number::VARCHAR, greatest(3, len(page_number::VARCHAR))::INTEGER, '0') || '_' || {_SAFE.format("theme")} || '/'
  || lpad(page_number::VARCHAR, greatest(3, len(page_number::VARCHAR))::INTEGER, '0') || '_' || lpad(photo_index::VARCHAR, greatest(2, len(photo_index::VARCHAR))::INTEGER, '0') || '_' || file_name AS target
FROM (SELECT DISTINCT page_number, photo_index, coalesce(theme, 'Collection') AS theme, photo_id FROM album_photos) a JOIN photos p ON p.id = a.photo_id""",
    "favorites_export": f"""SELECT id, file_path AS source, '{TARGET}/' || file_name AS target, row_number() OVER (PARTITION BY file_name ORDER BY id) = 1 AS copied
FROM photos WHERE is_favorite""",
    "page_theme": f"""
WITH k AS (SELECT DISTINCT page_number, coalesce(tags[1], 'Other') AS kind FROM (SELECT DISTINCT page_number, photo_id FROM album_photos) a JOIN ({CLEAN}) p ON p.id = a.photo_id),
  t AS (SELECT page_number, count(*)::INTEGER AS kinds, string_agg(replace(kind, ' ', '_'), '_and_' ORDER BY lower(kind), kind DESC) AS theme FROM k GROUP BY 1)
SELECT page_number, kinds, theme, {_SAFE.format("theme")} AS safe_theme FROM t""",
    "album_overview": """SELECT page_number, count(*) AS photos, min(date_taken) AS first, max(date_taken) AS last,
  (epoch_us(max(date_taken)) - epoch_us(min(date_taken))) / 1000000.0 AS seconds FROM album_photos GROUP BY 1""",
    "folder_tree": """
WITH p AS (SELECT string_split(regexp_replace(file_path, '^/', ''), '/') AS parts FROM photos WHERE file_path IS NOT NULL),
  a AS (SELECT parts[1:k] AS f, k FROM p, unnest(range(1, len(parts))) AS r(k))
SELECT '/' || array_to_string(f, '/') AS folder_path, f[-1] AS folder_name, CASE WHEN k > 1 THEN '/' || array_to_string(f[1:k - 1], '/') END AS parent_path,
  k::INTEGER AS depth, count(*) AS files FROM a GROUP BY f, k""",
}
