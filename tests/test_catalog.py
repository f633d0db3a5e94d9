from datetime import datetime

from pyspark.sql import functions as F

from fotoloom.operators import catalog, gallery
from fotoloom.operators.canonical import canonical_photos, device_key, drop_reimports, valid_date
from fotoloom.schema import PHOTOS
from fotoloom.sources.files import folder_tree, walk
from fotoloom.streaming.ingest import ingest, photo_stream, session_stream

D1, D2 = datetime(2024, 1, 1, 10), datetime(2024, 1, 2, 10)


def photo(i, path, date=D1, tags=(), **kw):
    row = dict(
        id=i, file_path=path, file_name=path.rpartition("/")[2], date_taken=date, file_size_bytes=1, is_analyzed=True, sharpness_score=60.0, face_count=0,
        is_favorite=False, tags=list(tags), feature_vector=None, scene_category=None, keywords="", primary_kind="",
    )
    return tuple((row | kw).values())


def rows(spark, *photos):
    return spark.createDataFrame(list(photos), PHOTOS)


def test_upsert_keeps_what_was_inserted_first(spark):
    stored = rows(spark, photo(1, "/p", D1, ["x"]))
    got = catalog.upsert(stored, rows(spark, photo(2, "/p", D2, ["y"]))).collect()
    assert [(r.file_path, r.date_taken, r.tags, r.id) for r in got] == [("/p", D1, ["y"], 1)]


def test_upsert_with_a_new_path_twice_in_the_batch(spark):
    got = catalog.upsert(rows(spark, photo(1, "/p")), rows(spark, photo(5, "/q", D1, ["x"]), photo(6, "/q", D2, ["y"], feature_vector=[1.0]))).where("file_path = '/q'").collect()
    assert [(r.date_taken, r.tags, r.feature_vector) for r in got] == [(D1, ["y"], [1.0])]


def test_an_update_may_set_a_vector_to_null(spark):
    got = catalog.upsert(rows(spark, photo(1, "/p", feature_vector=[1.0])), rows(spark, photo(2, "/p"))).collect()
    assert got[0].feature_vector is None


def test_point_update_of_an_unknown_path_changes_nothing(spark):
    stored = rows(spark, photo(1, "/p"))
    updates = spark.createDataFrame([("/nowhere", True)], "file_path string, is_favorite boolean")
    assert catalog.affected_rows(stored, updates) == 0
    assert not catalog.set_favorites(stored, updates).first().is_favorite


def test_versions(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    c.create()
    c.create()
    assert c.versions() == [0] and c.read().count() == 0
    c.save(rows(spark, photo(1, "/p", tags=["a"]), photo(2, "/q", tags=["b"], face_count=1)))
    assert c.set_favorites(spark.createDataFrame([("/p", True)], "file_path string, is_favorite boolean")) == 1
    c.clear_tags("face_count > 0")
    got = {r.file_path: (r.is_favorite, r.tags, r.is_analyzed) for r in c.read().collect()}
    assert got == {"/p": (True, ["a"], True), "/q": (False, [], False)}
    assert c.versions() == [0, 1, 2, 3] and c.read(1).where("is_favorite").count() == 0


def test_new_files_ignore_letter_case(spark):
    known = rows(spark, photo(1, "/A/x.jpg"))
    files = spark.createDataFrame([("/a/X.JPG",), ("/a/y.jpg",), ("/A/Y.JPG",), ("/a/notes.txt",), (None,)], "file_path string")
    assert [tuple(r) for r in gallery.new_files(files, known).collect()] == [("/A/Y.JPG", "Y.JPG")]


def test_folder_prefix_has_no_separator_unless_strict(spark):
    df = rows(spark, photo(1, "/a/b/1.jpg"), photo(2, "/a/bc/2.jpg"), photo(3, "/A/B/3.jpg"))
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(gallery.in_folder(df, "/a/b")) == [1, 2, 3]
    assert ids(gallery.in_folder(df, "/a/b", strict=True)) == [1, 3]
    assert ids(gallery.in_folder(df, None)) == []


def test_gallery_filters_and_order(spark):
    df = rows(spark, photo(1, "/a/1.jpg", D2, is_favorite=True, face_count=1), photo(2, "/a/2.jpg", D1, is_favorite=True), photo(3, "/a/3.jpg", D1, face_count=2))
    assert [r.id for r in gallery.gallery(df, "/a").collect()] == [2, 3, 1]
    assert [r.id for r in gallery.gallery(df, "/a", only_favorites=True, only_people=True).collect()] == [1]
    assert sorted(r.id for r in gallery.needs_analysis(df).collect()) == [1, 2, 3]
    manifest = gallery.favorites_manifest(rows(spark, photo(1, "/a/x.jpg", is_favorite=True), photo(2, "/b/x.jpg", is_favorite=True)), "/t").orderBy("id").collect()
    assert [(r.source, r.target, r.copied) for r in manifest] == [("/a/x.jpg", "/t/x.jpg", True), ("/b/x.jpg", "/t/x.jpg", False)]


def test_folder_tree(spark):
    tree = folder_tree(spark.createDataFrame([("/a/b/1.jpg",), ("/a/b/2.jpg",), ("/a/c/3.jpg",), (None,), ("4.jpg",)], "file_path string"))
    got = [(r.folder_path, r.parent_path, r.depth, r.files) for r in walk(tree, "/a").collect()]
    assert got == [("/a", None, 1, 3), ("/a/b", "/a", 2, 2), ("/a/c", "/a", 2, 1)]


def test_reimports(spark):
    df = spark.createDataFrame(
        [(5, "/A/x.jpg", "u"), (3, "/a/X.jpg", "v"), (9, "/a/x.jpg", "w"), (7, None, "n"), (8, None, "m"), (None, "/a/x.jpg", "z"), (4, "/b", "q")],
        "id int, file_path string, _row string",
    )
    assert sorted((r.id, r._row) for r in canonical_photos(df, "_row").collect()) == [(3, "v"), (4, "q"), (7, "n"), (8, "m")]
    assert sorted(r.id for r in drop_reimports(df).collect()) == [3, 4, 7, 8]
    assert drop_reimports(df.limit(0)).count() == 0


def test_keys_and_dates(spark):
    df = spark.createDataFrame([(" Cam-1 ", D1, D2), ("  ", D2, D1), (None, datetime(1989, 12, 31), D1), ("x", None, D1)], "device_id string, date_taken timestamp_ntz, imported_at timestamp_ntz")
    assert [r[0] for r in df.select(device_key()).collect()] == ["cam-1", None, None, "x"]
    assert df.where(valid_date()).count() == 1


def test_ingest_commits_batches(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows(spark, photo(1, "/p")).write.mode("append").parquet(source)
    rows(spark, photo(2, "/q")).write.mode("append").parquet(source)
    c = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    c.create()
    ingest(photo_stream(spark, source, 1), c, f"{tmp_path}/state").awaitTermination()
    assert sorted(r.file_path for r in c.read().collect()) == ["/p", "/q"] and len(c.versions()) >= 3


def test_session_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", D1), ("a", D1.replace(hour=12)), ("a", D2)], "device string, at timestamp_ntz").write.parquet(source)
    stream = session_stream(spark.readStream.schema("device string, at timestamp_ntz").parquet(source), "device", "at")
    q = stream.writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.events for r in spark.table("found").collect()) == [1, 2]
    assert spark.table("found").agg(F.count("*")).first()[0] == 2


def test_new_rows_get_ids_by_path(spark):
    got = catalog.with_ids(rows(spark, photo(7, "/k"), *(photo(0, f"/{c}") for c in "dacb")), 7).collect()
    assert {r.file_path: r.id for r in got} == {"/k": 7, "/a": 8, "/b": 9, "/c": 10, "/d": 11}
    assert catalog.with_ids(rows(spark, photo(1, "/k")).limit(0), 0).count() == 0


def test_ties_of_order_are_settled_by_values(spark):
    stored = rows(spark, photo(1, "/p")).limit(0)
    batch = [photo(0, "/q", D2, ["y"], file_size_bytes=2), photo(0, "/q", D1, ["x"], file_size_bytes=1)]
    both = [[(r.date_taken, r.tags) for r in catalog.upsert(stored, rows(spark, *b)).collect()] for b in (batch, batch[::-1])]
    assert both[0] == both[1] and len(both[0]) == 1


def test_the_second_of_two_writers_starts_again(spark, tmp_path):
    one, two = (catalog.Catalog(spark, f"file://{tmp_path}/catalog") for _ in range(2))
    one.create()
    one.save(rows(spark, photo(0, "/p", tags=["a"])))
    stale = two.versions()
    one.save(rows(spark, photo(0, "/q", tags=["b"])))
    assert not two._commit(rows(spark, photo(9, "/lost")), stale[-1] + 1)  # the version is taken, and nothing is left behind
    assert len([p for p in (tmp_path / "catalog").iterdir() if p.name.startswith("data-")]) == 3
    seen = iter([stale])
    whole = two.versions
    two.versions = lambda: next(seen, None) or whole()  # it believes the stale version to be current, once
    two.save(rows(spark, photo(0, "/r", tags=["c"])))
    assert {r.file_path: r.id for r in one.read().collect()} == {"/p": 1, "/q": 2, "/r": 3}
    assert one.versions() == [0, 1, 2, 3]


def test_new_photos_come_last_of_their_time(spark):
    got = gallery.gallery(rows(spark, photo(0, "/b"), photo(0, "/a"), photo(5, "/z")), "/").collect()
    assert [r.file_path for r in got] == ["/z", "/a", "/b"]
