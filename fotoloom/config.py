"""Every threshold of the curation pipeline in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CurationConfig:
    """Defaults are fixed values: results must agree with them."""

    # candidates
    min_sharpness: float = 50.0  # strictly above
    # episodes and bursts
    episode_gap_hours: float = 6.0  # strictly above splits
    episode_min_similarity: float = 0.45  # strictly below splits
    burst_window_seconds: float = 15.0  # up to and including
    duplicate_similarity: float = 0.92  # from
    # quota
    quota_floor: int = 10
    quota_tenths: int = 8
    # pages
    max_kinds_per_page: int = 2
    page_min_similarity: float = 0.35  # strictly below closes a page
    capacity_hero: int = 2
    capacity_social: int = 5
    capacity_default: int = 4
    hero_min_sharpness: float = 80.0
    hero_max_faces: int = 1
    hero_max_page: int = 2
    tail_merge_below: int = 6
    # score
    score_face: float = 200.0
    score_favorite: float = 2000.0
    score_landscape: float = 300.0
    score_architecture: float = 200.0
    score_sunset: float = 200.0
    # zero-shot tagging
    logit_scale: float = 4.765
    logit_bias: float = -12.932
    tag_min_probability: float = 0.20  # from, in single precision
    # faces
    face_confidence: float = 0.65  # strictly above, in single precision
    nms_iou: float = 0.4  # strictly above suppresses; single precision widened to double
    frame_width: int = 320
    frame_height: int = 240
    # files
    commit_batch: int = 100
    use_exif_date: bool = True
    strict_folder: bool = False


DEFAULTS = CurationConfig()

# Fixed values.
EXCLUDED_TAGS = (
    "Screenshot", "Computer & Tech", "Screen", "Monitor", "Document", "Paper", "Letter", "Text", "Document Photo",
    "Uninteresting", "Blurry", "Low Quality", "Empty",
)

# The tag kept, and the tag dropped beside it.
SYNONYMS = (
    ("Document", "Paper"), ("Screenshot", "Screen"), ("Running", "Jogging"), ("Children", "Kids"),
    ("Beach", "Seaside"), ("Snow", "Snowy landscape"), ("Dog", "Puppy"), ("Cat", "Kitten"),
    ("People & Social", "Social"), ("Computer & Tech", "Tech"),
)

# Fixed values.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "cr2", "nef")
