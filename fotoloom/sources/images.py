"""Pixels, sharpness, header dates and model results of image files, in Arrow batches.

Decoding uses Spark's own image source where it can (JPEG, PNG, GIF, BMP); for other formats a `decode` function from bytes
to an array of height x width x 3 (blue, green, red) comes second. A file that cannot be read gives a row with `decode_ok` false
and no scores, and never fails the job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.scratch import materialize


def sharpness(bgr: np.ndarray) -> float:
    """The variance of the Laplacian of the grey image (four neighbours, mirrored borders)."""
    grey = np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.float32)
    if min(grey.shape) < 2:
        return 0.0
    p = np.pad(grey, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    return float(lap.astype(np.float64).var())


def resized(bgr: np.ndarray, height: int, width: int, linear: bool) -> np.ndarray:
    h, w = bgr.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    if not linear:
        return bgr[np.minimum((np.arange(height) * h) // height, h - 1)][:, np.minimum((np.arange(width) * w) // width, w - 1)]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = bgr.astype(np.float32)
    return (f[y0][:, x0] * (1 - fy) + f[y1][:, x0] * fy) * (1 - fx) + (f[y0][:, x1] * (1 - fy) + f[y1][:, x1] * fy) * fx


def vision_tensor(bgr: np.ndarray, height: int = 224, width: int = 224) -> np.ndarray:
    """1 x 3 x height x width, red first, from -1 to 1."""
    rgb = resized(bgr, height, width, True)[..., ::-1]
    return (rgb / 127.5 - 1.0).astype(np.float32).transpose(2, 0, 1)[None]


def face_tensor(bgr: np.ndarray, height: int = 240, width: int = 320) -> np.ndarray:
    rgb = resized(bgr, height, width, False)[..., ::-1].astype(np.float32)
    return ((rgb - 127.0) / 128.0).transpose(2, 0, 1)[None].astype(np.float32)


def exif_date(head: bytes) -> str | None:
    """The original date of a JPEG's header, as text ("yyyy:MM:dd HH:mm:ss"); null if there is none or it is damaged."""
    try:
        at = head.find(b"Exif\x00\x00")
        if at < 0:
            return None
        tiff = head[at + 6 :]
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        u16 = lambda p: struct.unpack_from(order + "H", tiff, p)[0]
        u32 = lambda p: struct.unpack_from(order + "I", tiff, p)[0]

        def entries(start: int) -> dict[int, int]:
            return {u16(start + 2 + 12 * k): start + 2 + 12 * k for k in range(u16(start))}

        sub = entries(u32(4)).get(0x8769)
        found = entries(u32(sub + 8)).get(0x9003) if sub is not None else None
        if found is None:
            return None
        size, at = u32(found + 4), u32(found + 8)
        return tiff[at : at + size].split(b"\x00")[0].decode("ascii")
    except (struct.error, KeyError, UnicodeDecodeError, RecursionError):
        return None


def read_exif(files: DataFrame, leading: int = 131_072) -> DataFrame:
    """`path`, `exif_date` of a `binaryFile` table; only leading bytes reach Python."""
    slim = files.select("path", F.substring("content", 1, leading).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dates = [exif_date(h) if h else None for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dates, pa.string())], names=["path", "text"])

    exact = F.col("text").rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    return slim.mapInArrow(run, "path string, text string").select(
        "path", F.expr("try_to_timestamp(text, 'yyyy:MM:dd HH:mm:ss')").cast("timestamp_ntz").alias("_d"), exact.alias("_e")
    ).select("path", F.when(F.col("_e"), F.col("_d")).alias("exif_date"))


#: Names under which models give their vector, in the order in which they are looked for.
OUTPUT_NAMES = ("pooler_output", "image_embeds", "embedding", "output")


class OnnxModel:
    """A session per Python worker, made on first use; without a file every result is empty."""

    _sessions: dict = {}

    def __init__(self, path: str | None, outputs: tuple[str, ...] = OUTPUT_NAMES, dim: int = 768):
        self.path, self.outputs, self.dim = path, outputs, dim

    def session(self):
        if not self.path:
            return None
        if self.path not in self._sessions:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._sessions[self.path] = onnxruntime.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        return self._sessions[self.path]

    def embed(self, bgr: np.ndarray) -> np.ndarray | None:
        """The named output, else the one of the model's dimension, else the first."""
        s = self.session()
        if s is None:
            return None
        shape = s.get_inputs()[0].shape
        h, w = (d if isinstance(d, int) and d > 0 else 224 for d in shape[2:4])
        names = [o.name for o in s.get_outputs()]
        got = dict(zip(names, s.run(None, {s.get_inputs()[0].name: vision_tensor(bgr, h, w)})))
        for n in self.outputs:
            if n in got:
                return np.asarray(got[n], np.float32).ravel()
        return next((np.asarray(v, np.float32).ravel() for v in got.values() if np.asarray(v).size == self.dim), np.asarray(got[names[0]], np.float32).ravel())

    def faces(self, bgr: np.ndarray) -> list[tuple[int, float, float, float, float, float]]:
        """(anchor, x1, y1, x2, y2, score) of every anchor."""
        s = self.session()
        if s is None:
            return []
        got = {np.asarray(v).shape[-1]: np.asarray(v)[0] for v in s.run(None, {s.get_inputs()[0].name: face_tensor(bgr)})}
        return [(k, *map(float, box), float(score[1])) for k, (score, box) in enumerate(zip(got[2], got[4]))]


def pixels(height: int, width: int, channels: int, data: bytes | None) -> np.ndarray | None:
    """Height x width x 3 of an image as Spark decodes it, grey or with an alpha channel too; null if it is none."""
    if not data or height is None or height <= 0 or width <= 0 or len(data) != height * width * channels:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[..., :3] if channels in (3, 4) else None


_RESULTS = "path string, decode_ok boolean, sharpness_score double, feature_vector array<float>, boxes array<struct<anchor_idx:int,x1:float,y1:float,x2:float,y2:float,face_score:float>>"


def _seen(decode: Callable[..., np.ndarray | None], vision: OnnxModel | None, faces: OnnxModel | None):
    """What can be told from the pixels that `decode` makes of a row's columns after the path."""
    box = pa.struct([("anchor_idx", pa.int32()), *((c, pa.float32()) for c in ("x1", "y1", "x2", "y2", "face_score"))])
    types = [pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.float32()), pa.list_(box)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, *columns in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    bgr = decode(*columns)
                except Exception:  # a damaged file is a result, not a failure
                    bgr = None
                if bgr is None:
                    out.append((path, False, 0.0, None, []))
                    continue
                v = vision.embed(bgr) if vision is not None else None
                found = faces.faces(bgr) if faces is not None else []
                names = [f.name for f in box]
                out.append((path, True, sharpness(bgr), None if v is None else v.tolist(), [dict(zip(names, f)) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["path", "decode_ok", "sharpness_score", "feature_vector", "boxes"])

    return seen


def image_results(spark: SparkSession, folder: str, vision: OnnxModel | None = None, decode: Callable[[bytes], np.ndarray] | None = None, faces: OnnxModel | None = None) -> DataFrame:
    """`path`, `decode_ok`, `sharpness_score`, `feature_vector`, `boxes` of every image in a folder, sub-folders included.
    Spark's decoder comes first; what it cannot read goes to `decode`, if there is one."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    first = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(_seen(pixels, vision, faces), _RESULTS)
    if decode is None:
        return first
    first = materialize(first, "decoded")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    missed = first.where("not decode_ok").select(_local("path").alias("_path"))
    again = files.join(missed, _local("path") == F.col("_path"), "left_semi").select("path", "content").mapInArrow(_seen(decode, vision, faces), _RESULTS)
    return first.where("decode_ok").unionByName(again)


def _local(path: str):
    """A path without the scheme of local files, as the catalog has it."""
    return F.regexp_replace(path, "^file:(//)?", "")


def photo_results(spark: SparkSession, folder: str, vision: OnnxModel | None = None, faces: OnnxModel | None = None, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Everything that the analysis of an image asks for, a row per file: `file_path`, `decode_ok`, `sharpness_score`,
    `face_count`, `feature_vector`, `exif_date`."""
    from fotoloom.operators.detection import face_counts

    results = materialize(image_results(spark, folder, vision, decode, faces), "images")
    boxes = results.select(F.col("path").alias("image_id"), F.explode("boxes").alias("_b")).select("image_id", "_b.*")
    counts = face_counts(boxes).select(F.col("image_id").alias("_path"), F.col("faces").alias("face_count"))
    dates = read_exif(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)).select(_local("path").alias("file_path"), "exif_date")
    found = results.join(counts, F.col("path") == F.col("_path"), "left").select(
        _local("path").alias("file_path"), "decode_ok", "sharpness_score", F.coalesce("face_count", F.lit(0)).alias("face_count"), "feature_vector"
    )
    return found.join(dates, "file_path", "left")


def detect_faces(images: DataFrame, model: OnnxModel) -> DataFrame:
    """Detections (`image_id`, `anchor_idx`, corners, `face_score`) of an image table `image_id`, `height`, `width`,
    `nChannels` (3 where the column is missing), `data`. What is no image has none."""
    channels = F.col("nChannels") if "nChannels" in images.columns else F.lit(3)
    kind = images.schema["image_id"].dataType.simpleString()
    slim = images.select(F.col("image_id").cast("string").alias("path"), "height", "width", channels.alias("nChannels"), "data")
    seen = slim.mapInArrow(_seen(pixels, None, model), _RESULTS)
    return seen.select(F.col("path").cast(kind).alias("image_id"), F.explode("boxes").alias("_b")).select("image_id", "_b.*")
