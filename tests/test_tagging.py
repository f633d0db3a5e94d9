import json
import random

import pytest
from pyspark.sql import functions as F

from fotoloom.config import DEFAULTS
from fotoloom.functions import naming
from fotoloom.functions import tags as T
from fotoloom.functions.vectors import cosine, dot, probability, unit
from fotoloom.operators import detection, tagging
from fotoloom.schema import CATEGORIES, DETECTIONS
from fotoloom.sources.categories import read_categories
from tests.test_catalog import photo, rows

VOCABULARY = [
    (0, "", ["People & Social", "Discussion"], [1.0, 0.0, 0.0]), (1, "", ["Landscape", "Other"], [0.0, 1.0, 0.0]), (2, "", ["Food & Dining", "people & social"], [0.0, 0.0, 1.0]),
]


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_cosine(spark):
    cos = lambda a, b: one(spark, "a array<float>, b array<float>", tuple(None if v is None else [float(x) for x in v] for v in (a, b)), cosine("a", "b"))
    assert cos([0.5, 0.5, 0, 0], [0.5, 0.5, 0, 0]) == pytest.approx(1)
    assert cos([0.5, 0.5, 0, 0], [0, 0, 1.0, 1.0]) == 0
    rng = random.Random(42)
    v = [rng.random() for _ in range(768)]
    assert cos(v, [2 * x for x in v]) == pytest.approx(1)
    assert cos([1.0, 5.0], [1.0]) == pytest.approx(1) and cos(None, [1.0]) == 0 and cos([], [1.0]) == 0 and cos([0.0], [1.0]) == 0


def test_unit_and_probability(spark):
    assert one(spark, "v array<float>", ([3.0, 4.0],), unit("v")) == pytest.approx([0.6, 0.8])
    assert one(spark, "v array<float>", ([0.0, 0.0],), unit("v")) == [0.0, 0.0]
    for product, p in ((0.1, 0.2317), (0.0985, 0.2018), (0.0983, 0.1981), (0.09, 0.0853), (0.0, 2.419e-6)):
        assert one(spark, "d double", (product,), probability(F.col("d"), DEFAULTS.logit_scale, DEFAULTS.logit_bias)) == pytest.approx(p, rel=1e-3)
    assert one(spark, "a array<float>, b array<float>", ([1.0, 2.0, 9.0], [3.0, 4.0]), dot("a", "b", single=True)) == 11


@pytest.mark.parametrize(
    "vector,tags,confidence",
    [
        ([0.8, 0.0, 0.6], ["People & Social", "Discussion", "Food & Dining"], 1.0), ([0.0, 1.0, 0.0], ["Landscape"], 1.0),
        ([0.0, 0.0, 0.0], ["People & Social", "Discussion"], 2.419e-6), ([0.0, -1.0, 0.0], ["People & Social", "Discussion"], 2.419e-6),
        ([], ["Other"], 0.0), (None, ["Other"], 0.0), ([1.0, None, 0.0], ["Other"], 0.0),
    ],
)
def test_zero_shot(spark, vector, tags, confidence):
    df = spark.createDataFrame([(1, vector)], "id int, feature_vector array<float>")
    got = tagging.zero_shot_tags(df, spark.createDataFrame(VOCABULARY, CATEGORIES)).first()
    assert got.tags == tags and got.confidence == pytest.approx(confidence, rel=1e-3)


def test_analysis_routes(spark):
    zeros = [0.0] * 768
    df = rows(spark, photo(1, "/a", tags=["ExistingTag"], feature_vector=zeros), photo(2, "/b", feature_vector=zeros, is_analyzed=False, face_count=1), photo(3, "/c", is_analyzed=False))
    seen = spark.createDataFrame([("/c", 12.0, 2, [0.0, 1.0, 0.0], None)], "file_path string, sharpness_score double, face_count int, feature_vector array<float>, exif_date timestamp_ntz")
    got = {r.id: r for r in tagging.analyze(df, spark.createDataFrame(VOCABULARY, CATEGORIES), seen).collect()}
    assert got[1].tags == ["ExistingTag"] and got[2].tags[0] == "Person" and len(got[2].tags) > 1
    assert got[3].tags == ["Person", "Landscape"] and got[3].sharpness_score == 12.0 and all(r.is_analyzed for r in got.values())


def test_tag_lists(spark):
    tag = lambda c, v, faces=0: one(spark, "tags array<string>, faces int", (v, faces), c)
    assert tag(T.without_synonyms("tags"), ["Document", "Paper", "Screenshot", "Screen", "Running", "Jogging"]) == ["Document", "Screenshot", "Running"]
    assert tag(T.without_synonyms("tags"), ["Paper"]) == ["Paper"] and tag(T.without_synonyms("tags"), ["puppy", "DOG"]) == ["DOG"]
    assert tag(T.with_person("tags", "faces"), ["Dog"], 1) == ["Person", "Dog"] and tag(T.with_person("tags", "faces"), ["person", "Dog"], 1) == ["person", "Dog"]
    assert tag(T.catalog_tags("tags"), [" a ", None, " ", "b"]) == ["a", "b"] and tag(T.catalog_tags("tags"), None) == []
    assert tag(T.primary_tag("tags"), []) == "Other" and tag(T.tags_display("tags"), []) == "Untagged" and tag(T.tags_display("tags"), ["a", "b"]) == "a, b"
    text = lambda c, v: one(spark, "t string", (v,), c)
    assert text(T.tags_from_text("t"), "Person, Snow ,,  Dog") == ["Person", "Snow", "Dog"] and text(T.tags_from_text("t"), "  ") == []
    assert text(T.vector_from_text("t"), "1.5,-0.002,,7") == pytest.approx([1.5, -0.002, 7.0])
    assert text(T.vector_from_text("t"), "1,x") is None and text(T.vector_from_text("t"), "") is None and text(T.vector_from_text("t"), None) is None


def test_names(spark):
    kinds = lambda v: one(spark, "k array<string>", (v,), naming.theme("k"))
    assert kinds(["Person", "Landscape", "Person"]) == "Landscape_and_Person" and kinds(["architecture", "Landscape"]) == "architecture_and_Landscape" and kinds([]) == "Collection"
    assert one(spark, "n string", ("a/b:c_",), naming.safe_name("n")) == "a_b_c"
    assert one(spark, "n int, t string", (1234, "x"), naming.page_folder("n", "t")) == "Page_1234_x"


def boxes(spark, *b):
    return spark.createDataFrame([(1, k, x1 / 320, y1 / 240, x2 / 320, y2 / 240, s) for k, (x1, y1, x2, y2, s) in enumerate(b)], DETECTIONS)


@pytest.mark.parametrize("b,n", [([(0.0, 0.0, 10.0, 10.0, 0.9), (0.0, 0.0, 10.0, 5.0, 0.8)], 1), ([(0.0, 0.0, 10.0, 10.0, 0.65)], 0), ([(0.0, 0.0, 10.0, 10.0, 0.9), (20, 20, 30, 30, 0.7), (0.0, 0.0, 10.0, 10.0, 0.9)], 2)])
def test_suppression(spark, b, n):
    assert detection.face_counts(boxes(spark, *b)).first().faces == n


def test_an_overlap_of_exactly_the_limit_survives(spark):
    px = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 4.0, 0.8), (1, 2, 5.0, 5.0, 5.0, 9.0, 0.7), (None, 0, 0.0, 0.0, 1.0, 1.0, 0.9)],
                               "image_id int, anchor_idx int, x1 double, y1 double, x2 double, y2 double, face_score float")
    assert [len(r.kept) for r in detection.suppress(px).collect()] == [3]


def test_null_boxes(spark):
    df = spark.createDataFrame([(1, 0, None, 0.0, 1.0, 1.0, 0.9), (2, 0, 0.0, 0.0, 1.0, 1.0, None), (3, 0, 1.0, 1.0, 0.0, 0.0, 0.9)], DETECTIONS)
    assert {r.image_id: r.faces for r in detection.face_counts(df).collect()} == {1: 0, 2: 0, 3: 1}
    assert detection.face_counts(df.limit(0)).count() == 0


def test_vocabulary_file(spark, tmp_path):
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"LogitScale": 2.0, "Categories": [{"Prompt": "p", "Tags": ["A"], "Embedding": [1.0, 0.0]}]}, indent=1))
    got, cfg = read_categories(spark, str(tmp_path / "missing.json"), str(path))
    assert got.first().tags == ["A"] and cfg.logit_scale == 2.0 and cfg.logit_bias == DEFAULTS.logit_bias
    fallback, _ = read_categories(spark, str(tmp_path / "missing.json"))
    assert fallback.first().tags == ["Other"]
