"""Faces: confident boxes and greedy suppression of overlapping ones.

Each image's confident boxes are folded in the JVM. Exact repetitions of a box (same corners) cannot survive one another,
so they are combined to their best score before the shuffle, and a flood of copies costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotoloom.config import DEFAULTS, CurationConfig


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)


def confident_boxes(detections: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """Boxes above the confidence, in pixels of the detector's frame; negative extents are empty. Null corners or a null
    score are no box."""
    px = lambda c, size: F.col(c).cast("double") * size
    x1, y1 = px("x1", cfg.frame_width), px("y1", cfg.frame_height)
    w = F.greatest(px("x2", cfg.frame_width) - x1, F.lit(0.0))
    h = F.greatest(px("y2", cfg.frame_height) - y1, F.lit(0.0))
    return detections.where(F.col("face_score") > F.lit(cfg.face_confidence).cast("float")).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select(
        "image_id", "anchor_idx", x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), "face_score"
    )


def suppress(boxes: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """`image_id`, `kept`: the boxes that survive, best first (ties by anchor, then corners)."""
    corners = ("x1", "y1", "x2", "y2")
    once = boxes.where("image_id is not null and (x2 > x1 and y2 > y1)").groupBy("image_id", *corners).agg(F.min(F.struct((-F.col("face_score")).alias("n"), "anchor_idx")).alias("_b"))
    # Empty boxes overlap nothing: each survives.
    flat = boxes.where("image_id is not null and not (x2 > x1 and y2 > y1)").select("image_id", *corners, F.struct((-F.col("face_score")).alias("n"), "anchor_idx").alias("_b"))
    row = F.struct(F.col("_b.n").alias("n"), F.col("_b.anchor_idx").alias("anchor_idx"), *corners)
    ordered = once.unionByName(flat.select(once.columns)).groupBy("image_id").agg(F.sort_array(F.collect_list(row)).alias("_boxes"))
    limit = float(single(cfg.nms_iou))
    kept = F.aggregate(
        "_boxes",
        F.filter("_boxes", lambda b: F.lit(False)),
        lambda kept, b: F.when(F.exists(kept, lambda k: _overlap(k, b) > limit), kept).otherwise(F.array_append(kept, b)),
    )
    return ordered.select("image_id", kept.alias("kept"))


def single(x: float) -> float:
    """A single-precision constant widened to double."""
    import numpy as np

    return float(np.float32(x))


def face_counts(detections: DataFrame, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """`image_id`, `faces` of every image with detections; 0 if none is confident."""
    kept = suppress(confident_boxes(detections, cfg), cfg).select("image_id", F.size("kept").alias("faces"))
    images = detections.where("image_id is not null").select("image_id").distinct()
    return images.join(kept, "image_id", "left").select("image_id", F.coalesce("faces", F.lit(0)).alias("faces"))
