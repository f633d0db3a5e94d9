from datetime import datetime

import numpy as np

from fotoloom.operators.catalog import Catalog
from fotoloom.plans import workflows
from fotoloom.schema import CATEGORIES
from tests.test_catalog import photo, rows
from tests.test_sources import png, square
from fotoloom.sources.images import photo_results
from tests.test_tagging import VOCABULARY


def test_from_folder_to_album(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(square()))
    (folder / "B.PNG").write_bytes(png(square()))
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.create()
    catalog.save(rows(spark, photo(1, f"{folder}/b.png", datetime(2024, 1, 1), is_analyzed=False, feature_vector=[0.0, 1.0, 0.0], is_favorite=True)))
    shown = workflows.open_folder(spark, catalog, str(folder))
    assert [(r.id, r.file_name) for r in shown.collect()] == [(1, "b.png"), (0, "a.png")]
    assert workflows.analyze_shown(catalog, shown, spark.createDataFrame(VOCABULARY, CATEGORIES)) == 2
    stored = {r.file_name: r for r in catalog.read().collect()}
    assert stored["b.png"].tags == ["Landscape"] and stored["a.png"].tags == ["Other"] and all(r.is_analyzed for r in stored.values())
    said = []
    (folder / "b.png").write_bytes(b"x")
    assert workflows.generate_album(catalog.read(), f"{tmp_path}/album", said.append) == 1 and len(said) == 3
    assert (tmp_path / "album/Page_001_Landscape/001_01_b.png").exists() and (tmp_path / "album/preview.html").exists()
    assert workflows.generate_album(catalog.read().limit(0), f"{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
    assert workflows.export_favorites(catalog.read(), f"{tmp_path}/favorites") == 1 and (tmp_path / "favorites/b.png").exists()


class Constant:
    """A model that gives every image one vector."""

    def embed(self, bgr):
        return np.array([0.0, 1.0, 0.0], np.float32)

    def faces(self, bgr):
        return [(0, 0.1, 0.1, 0.5, 0.5, 0.9), (1, 0.1, 0.1, 0.5, 0.49, 0.8)]


def test_fifty_new_files_end_to_end(spark, tmp_path):
    """Grey, damaged and ordinary files: unique ids, results by path, commits of a few photos, one manifest row per photo."""
    from fotoloom.operators import album
    from fotoloom.operators.export import album_manifest
    from tests.test_sources import grey_png

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(50):
        data = b"damaged" if k % 10 == 9 else grey_png() if k % 10 == 8 else png(square())
        (folder / f"p{k:02d}.png").write_bytes(data)
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.create()
    shown = workflows.open_folder(spark, catalog, str(folder))
    images = photo_results(spark, str(folder), Constant(), Constant())
    said = []
    assert workflows.analyze_shown(catalog, shown, spark.createDataFrame(VOCABULARY, CATEGORIES), images, progress=lambda done, of: said.append((done, of)), commit=20) == 50
    assert said[-1] == (50, 50) and len(said) == 3
    stored = catalog.read().cache()
    assert sorted(r.id for r in stored.collect()) == list(range(1, 51)) and stored.where("is_analyzed").count() == 50
    got = {r.file_name: r for r in stored.collect()}
    assert got["p00.png"].tags == ["Person", "Landscape"] and got["p00.png"].face_count == 1 and got["p00.png"].sharpness_score > 0
    assert got["p08.png"].tags == ["Person", "Landscape"] and got["p09.png"].tags == ["Other"] and got["p09.png"].sharpness_score == 0
    made = album.album(stored)
    paged = made.join(album.page_summary(made).select("page_number", "theme"), "page_number")
    assert album_manifest(paged, stored, "/t").count() == made.count() > 0
    again = workflows.open_folder(spark, catalog, str(folder))
    assert again.count() == 50 and workflows.analyze_shown(catalog, again, spark.createDataFrame(VOCABULARY, CATEGORIES)) == 0
