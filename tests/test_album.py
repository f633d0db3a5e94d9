import math
from datetime import datetime, timedelta

import pytest

from fotoloom.operators import album
from fotoloom.operators.export import album_manifest, copy_files, preview_html, write_previews
from tests.test_catalog import photo, rows

DAY = datetime(2024, 5, 5, 8)


def at(angle):
    return [math.cos(math.radians(angle)), math.sin(math.radians(angle))]


def shoot(spark, n, step=60, **kw):
    """n photos, equal but for what is listed by name."""
    out = []
    for k in range(n):
        own = {name: v[k] if isinstance(v, list) and len(v) == n and name != "vector" else v for name, v in kw.items()}
        own.setdefault("tags", ["Work & Industry"])
        own.setdefault("feature_vector", [1.0, 0.0])
        out.append(photo(k + 1, f"/p{k + 1}.jpg", own.pop("date", DAY + timedelta(seconds=step * k)), **own))
    return rows(spark, *out)


def pages(df):
    got = {}
    for r in album.album(df).orderBy("page_number", "photo_index").collect():
        got.setdefault(r.page_number, []).append(r.photo_id)
    assert list(got) == list(range(1, len(got) + 1))
    return list(got.values())


def split(df):
    got = {}
    for r in album.episodes(album.album_candidates(df)).orderBy("date_taken", "id").collect():
        got.setdefault((r.taken_date, r.episode), []).append(r.id)
    return list(got.values())


def test_episode_gap_is_strict(spark):
    day = DAY.replace(hour=0)
    assert split(shoot(spark, 3, date=[day + timedelta(hours=8), day + timedelta(hours=14), day + timedelta(hours=20, seconds=1)])) == [[1, 2], [3]]


def test_a_new_date_splits(spark):
    assert split(shoot(spark, 2, date=[DAY.replace(hour=23, minute=59, second=59), DAY.replace(day=6, hour=0, second=1)])) == [[1], [2]]


def test_unlike_photos_split_but_missing_vectors_do_not(spark):
    vectors = [[1.0, 0.0], None, [0.0, 1.0], [0.0, -1.0]]
    assert split(shoot(spark, 4, feature_vector=vectors)) == [[1, 2, 3], [4]]


@pytest.mark.parametrize(
    "n,kw,expected",
    [
        (4, dict(feature_vector=[at(0), at(60), at(120), at(120)], tags=[["Food & Dining"]] * 4, step=60), [[1, 2], [3, 4]]),
        (3, dict(feature_vector=[at(0), at(60), at(120)], tags=[["Food & Dining"]] * 3), [[1, 2, 3]]),
        (9, {}, [[1, 2, 3, 4], [5, 6, 7, 8, 9]]),
        (10, dict(face_count=2), [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]]),
        (6, dict(face_count=2), [[1, 2, 3, 4, 5, 6]]),
        (5, dict(tags=[["Landscape"]] * 5, sharpness_score=80.0, face_count=1), [[1, 2], [3, 4, 5]]),
        (6, dict(tags=[["Work & Industry"], ["Work & Industry"], ["Landscape"], *[["Work & Industry"]] * 3], sharpness_score=90.0), [[1, 2, 3, 4], [5, 6]]),
        (5, dict(tags=[["A"], ["B"], ["C"], ["C"], ["A"]]), [[1, 2], [3, 4, 5]]),
        (3, dict(tags=[["A"], ["B"], ["C"]]), [[1, 2], [3]]),
    ],
)
def test_pages(spark, n, kw, expected):
    assert pages(shoot(spark, n, **kw)) == expected


def test_quota(spark):
    df = shoot(spark, 13, sharpness_score=[60.0 + k for k in range(1, 14)])
    assert pages(df) == [[4, 5, 6, 7], [8, 9, 10, 11], [12, 13]]
    for n, kept in ((9, 9), (10, 10), (11, 10), (12, 10), (13, 10), (20, 16)):
        assert album.selected_photos(shoot(spark, n)).count() == kept


@pytest.mark.parametrize("scores,kept", [([60, 70, 55], [2]), ([70, 60, 55], [1, 3]), ([60, 60, 55], [1, 3])])
def test_replaced_representatives_drift(spark, scores, kept):
    df = shoot(spark, 3, step=5, feature_vector=[at(0), at(20), at(40)], sharpness_score=[float(s) for s in scores])
    assert sorted(r.id for r in album.selected_photos(df).collect()) == kept


def test_burst_window_is_inclusive(spark):
    df = shoot(spark, 3, date=[DAY, DAY + timedelta(seconds=15), DAY + timedelta(seconds=30, milliseconds=1)])
    assert sorted(r.id for r in album.selected_photos(df).collect()) == [1, 3]


def test_photos_without_vectors_are_no_duplicates(spark):
    assert album.selected_photos(shoot(spark, 2, step=1, feature_vector=[None, []])).count() == 2


def test_scores(spark):
    df = rows(spark, photo(1, "/a", tags=["Snowy landscape", "Beach", "Sunset"], sharpness_score=100.0, face_count=2, is_favorite=True), photo(2, "/b", tags=["Architecture", "Landmark"], sharpness_score=10.5))
    assert [r.s for r in df.orderBy("id").select(album.photo_score().alias("s")).collect()] == [3000.0, 210.5]


def test_candidates(spark):
    df = rows(
        spark, photo(1, "/a", tags=["screenshot"], is_favorite=True), photo(2, "/b", tags=["Dog"], is_favorite=True, is_analyzed=False), photo(3, "/c", tags=["Dog"], sharpness_score=50.0),
        photo(4, "/d", tags=["Dog"], sharpness_score=50.0001),
    )
    assert sorted(r.id for r in album.album_candidates(df).collect()) == [2, 4]
    assert album.album(df.limit(0)).count() == 0


def test_themes_and_export(spark, tmp_path):
    names = [["Landscape"], ["Person"], ["Architecture"], ["Leisure & Recreation", "park"]]
    vectors = [[float(i == j) for j in range(4)] for i in range(4)]
    df = shoot(spark, 4, step=3600, tags=names, feature_vector=vectors, sharpness_score=[100.0, 120.0, 110.0, 105.0])
    made = album.album(df)
    summary = album.page_summary(made).orderBy("page_number").collect()
    assert [r.theme for r in summary] == ["Landscape", "Person", "Architecture", "Leisure_&_Recreation"]
    (tmp_path / "p1.jpg").write_bytes(b"x")
    paged = made.join(album.page_summary(made).select("page_number", "theme"), "page_number")
    manifest = album_manifest(paged, df.selectExpr("id", f"concat('{tmp_path}', file_path) as file_path", "file_name"), f"{tmp_path}/out")
    assert manifest.count() == 4
    copy_files(manifest)
    assert (tmp_path / "out/Page_001_Landscape/001_01_p1.jpg").exists()
    page = preview_html(paged.withColumnRenamed("taken_date", "date_taken"), df, "A & B")
    assert page.count("<img") == 4 and "A &amp; B" in page and "May 05, 2024" in page


def test_previews_of_a_large_album(spark, tmp_path):
    ids = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1)]
    rows = spark.createDataFrame([(p, k, "T", 10 * p + k, None) for p, k in ids], "page_number int, photo_index int, theme string, photo_id int, date_taken timestamp")
    photos = rows.selectExpr("photo_id as id", "concat('/f/', photo_id, '.jpg') as file_path", "concat(photo_id, '.jpg') as file_name")
    assert write_previews(rows, photos, str(tmp_path), most=3) == 4
    files = ["preview.html", *(f"preview_{n:03d}.html" for n in range(2, 5))]
    texts = [(tmp_path / f).read_text() for f in files]
    assert [[p * 10 + k for p, k in ids if f"/f/{p * 10 + k}.jpg" in t] for t in texts] == [[11, 12], [21, 22], [31, 32, 33], [34, 41]]
    assert "Next" in texts[0] and "Previous" not in texts[0] and "Next" not in texts[-1]


def test_exclusion_in_the_album(spark):
    df = shoot(spark, 4, step=3600, tags=[["Landscape"], ["Screenshot", "Computer & Tech"], ["Document", "Paper"], ["Uninteresting", "Blurry"]])
    assert pages(df) == [[1]]


def test_ranges_of_one_day_are_put_together(spark):
    """A day cut into many ranges gives the same as in one piece: episodes, bursts and pages go on over the cuts."""
    import random

    rng, made, t = random.Random(5), [], DAY.replace(hour=0)
    for k in range(240):
        t += timedelta(seconds=rng.choice([0, 3, 9, 14, 15, 16, 40, 200]) if k % 60 else 0)
        v = rng.choice([at(0), at(5), at(15), at(80), at(100), None, [], [1.0], [0.0, 0.0]])
        made.append(photo(k + 1, f"/p{k}.jpg", t if k < 200 else t + timedelta(days=k - 199), tags=[rng.choice("ABC")], feature_vector=v, sharpness_score=60.0 + rng.random()))
    df, ways = rows(spark, *made), []
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for partitions in ("1", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        marked = album.bursts(album.episodes(album.album_candidates(df)))
        ways.append((sorted((r.id, r.episode, r.burst) for r in marked.collect()), sorted(map(tuple, album.album(df).collect()))))
    for c, v in kept.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert ways[0] == ways[1] == ways[2] and len(ways[0][0]) == 240
