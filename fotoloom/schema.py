"""Schemas of the catalog and its companions."""

from __future__ import annotations

from pyspark.sql import types as T

PHOTOS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("date_taken", T.TimestampNTZType(), False),
        T.StructField("file_size_bytes", T.LongType(), False),
        T.StructField("is_analyzed", T.BooleanType(), False),
        T.StructField("sharpness_score", T.DoubleType(), False),
        T.StructField("face_count", T.IntegerType(), False),
        T.StructField("is_favorite", T.BooleanType(), False),
        T.StructField("tags", T.ArrayType(T.StringType()), False),
        T.StructField("feature_vector", T.ArrayType(T.FloatType()), True),
        T.StructField("scene_category", T.StringType(), True),  # kept for compatibility, never written
        T.StructField("keywords", T.StringType(), False),  # likewise
        T.StructField("primary_kind", T.StringType(), False),  # likewise
    ]
)
CATEGORIES = T.StructType(
    [
        T.StructField("category_idx", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
DETECTIONS = T.StructType(
    [T.StructField("image_id", T.IntegerType()), T.StructField("anchor_idx", T.IntegerType())]
    + [T.StructField(c, T.FloatType()) for c in ("x1", "y1", "x2", "y2", "face_score")]
)
ALBUM_PHOTOS = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("photo_index", T.IntegerType()),
        T.StructField("theme", T.StringType()),
        T.StructField("photo_id", T.IntegerType()),
        T.StructField("date_taken", T.TimestampNTZType()),
    ]
)
