import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from fotoloom.sources.files import scan_images
from fotoloom.sources.images import OnnxModel, exif_date, face_tensor, image_results, read_exif, sharpness, vision_tensor


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + r.tobytes() for r in pixels[..., ::-1].astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def grey_png():
    grey = square()[..., 0]
    h, w = grey.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + r.tobytes() for r in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def header(text, order="<"):
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8)
    tiff += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, 26) + struct.pack(order + "I", 0)
    tiff += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, len(text) + 1, 44) + struct.pack(order + "I", 0)
    return b"\xff\xd8\xff\xe1\x00\x00Exif\x00\x00" + tiff + text.encode() + b"\0"


def square():
    a = np.full((48, 64, 3), 30, np.uint8)
    a[10:30, 10:30] = (200, 40, 90)
    return a


def test_sharpness():
    assert sharpness(np.full((20, 20, 3), 77, np.uint8)) == 0
    assert sharpness(square()) > 0
    assert sharpness(np.zeros((1, 9, 3), np.uint8)) == 0


def test_tensors():
    assert vision_tensor(square()).shape == (1, 3, 224, 224) and face_tensor(square()).shape == (1, 3, 240, 320)
    assert np.allclose(vision_tensor(np.full((5, 5, 3), 255, np.uint8)), 1.0)


def test_header_dates():
    assert exif_date(header("2021:03:04 05:06:07")) == "2021:03:04 05:06:07" == exif_date(header("2021:03:04 05:06:07", ">"))
    assert exif_date(b"nothing") is None and exif_date(header("2021:03:04 05:06:07")[:40]) is None


def test_image_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.PNG").write_bytes(png(square()))
    (tmp_path / "flat.png").write_bytes(png(np.full((9, 9, 3), 5, np.uint8)))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    files = {r.file_name: r.file_size_bytes for r in scan_images(spark, str(tmp_path)).collect()}
    assert set(files) == {"a.PNG", "flat.png", "bad.jpg"} and files["bad.jpg"] == 8
    got = {r.path.rpartition("/")[2]: r for r in image_results(spark, str(tmp_path), OnnxModel(None)).collect()}
    assert abs(got["a.PNG"].sharpness_score - sharpness(square())) < 1e-6 and got["flat.png"].sharpness_score == 0
    assert got["flat.png"].decode_ok and not got["bad.jpg"].decode_ok and got["a.PNG"].feature_vector is None
    other = image_results(spark, str(tmp_path), decode=lambda raw: square() if raw[:2] == b"no" else 1 / 0)
    assert {r.path.rpartition("/")[2]: r.decode_ok for r in other.collect()}["bad.jpg"]


def test_exif_table(spark):
    df = spark.createDataFrame([("a", header("2021:03:04 05:06:07")), ("b", header("2021:13:04 05:06:07")), ("c", b""), ("d", None), ("e", header("2021:3:4 5:6:7    "))], "path string, content binary")
    got = {r.path: r.exif_date for r in read_exif(df).withColumn("exif_date", F.col("exif_date").cast("string")).collect()}
    assert got == {"a": "2021-03-04 05:06:07", "b": None, "c": None, "d": None, "e": None}
