"""Image kernels and forensics against direct loops and literal values."""

import math
import random
import zlib

import numpy as np
import pytest

from arraylume.operators import forensics
from arraylume.operators.composite import CompositePipeline, describe, to_byte
from arraylume.operators.image import kernels as k
from arraylume.operators.image import ops
from arraylume.sources import images


def ramp(w, h, a, m):
    return (np.arange(w * h) * a % m / (m - 1)).reshape(h, w)


def test_box_blur_residual_downsample():
    p = np.array([[0, 0], [0, 1.0]])
    assert k.box_blur(p).ravel().tolist() == [0.25] * 4
    assert k.residual(p)[1, 1] == 0.75 and k.downsample(p, 1, 1)[0, 0] == 0.25


def test_convolution_by_loop():
    p, kernel = ramp(11, 7, 29, 53), np.array([[0, -1, 0], [-1, 4, -1], [0.5, -1, 0]])
    for boundary in ("clamp", "zero"):
        got = k.convolve2d(p, kernel, boundary)
        for y in range(7):
            for x in range(11):
                total = 0.0
                for i in range(3):
                    for j in range(3):
                        yy, xx = y + i - 1, x + j - 1
                        if boundary == "clamp":
                            total += kernel[i, j] * p[min(max(yy, 0), 6), min(max(xx, 0), 10)]
                        elif 0 <= yy < 7 and 0 <= xx < 11:
                            total += kernel[i, j] * p[yy, xx]
                assert got[y, x] == pytest.approx(total)


@pytest.mark.parametrize("r", [0, 1, 3, 9])
def test_windows_by_loop(r):
    p = ramp(13, 9, 23, 71)
    blur, contrast, bits = k.box_blur(p, r), k.local_contrast(p, r), k.local_entropy(p, r, 8)
    for y in range(9):
        for x in range(13):
            part = p[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            assert blur[y, x] == pytest.approx(part.mean())
            assert contrast[y, x] == pytest.approx(part.max() - part.min())
            n = np.bincount(np.minimum(7, (part * 8).astype(int)).ravel())
            q = n[n > 0] / n.sum()
            assert bits[y, x] == pytest.approx(-(q * np.log2(q)).sum(), abs=1e-9)


def test_colour():
    assert k.srgb_to_linear([0, 1, 0.5]) == pytest.approx([0, 1, 0.21404114], abs=1e-6)
    assert k.linear_to_srgb(k.srgb_to_linear(np.linspace(0, 1, 50))) == pytest.approx(np.linspace(0, 1, 50), abs=1e-6)
    assert [k.luminance(*c) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))] == [0.2126, 0.7152, 0.0722]


def test_bayer_round_trip_of_a_constant():
    p = np.full((6, 8), 0.3)
    for pattern in k.BAYER:
        assert sum(k.bayer_masks(8, 6, pattern)).min() == 1
        for plane in k.demosaic(k.to_bayer(p, p, p, pattern), pattern):
            assert plane == pytest.approx(p)


def test_seeded_generator_and_noise():
    # The first values of the subtractive generator for seed 1.
    assert k.subtractive_uniforms(1, 3) == pytest.approx([0.24866858, 0.11074397, 0.46701068], abs=1e-8)
    slow = k.subtractive_uniforms(42, 500)
    assert len(set(slow.tolist())) > 490 and 0 <= slow.min() < slow.max() < 1
    n = k.standard_normals(7, 20001)
    assert abs(n.mean()) < 0.03 and abs(n.std() - 1) < 0.03
    p = np.full((64, 64), 0.5)
    assert (k.read_noise(p, 0.0) == p).all()
    assert k.shot_noise(p, 0.01, 3).std() == pytest.approx(math.sqrt(0.005), rel=0.1)
    assert (k.signal_noise(p, 0.01, 0.01, 5) == k.signal_noise(p, 0.01, 0.01, 5)).all()


def test_radial_spectrum_and_peaks():
    p = ramp(16, 8, 37, 97)
    rings, bands = k.radial_spectrum(p, 12)
    assert rings.sum() == pytest.approx(1) and bands.sum() == pytest.approx(p.sum())
    flat = np.ones((8, 8))
    flat[3, 3] = 50
    assert k.peak_metrics(flat)[1] == 1


def test_resize_keeps_corners():
    p = ramp(7, 5, 17, 31)
    out = k.resize(p, 13, 9)
    assert [out[0, 0], out[-1, -1]] == [p[0, 0], p[-1, -1]]
    assert k.resize(p, 7, 5) == pytest.approx(p)
    with pytest.raises(ValueError):
        k.crop(p, 5, 0, 3, 2)


def sheet(spark, planes, encoding="linear"):
    h, w = planes[0].shape
    return spark.createDataFrame([(1, w, h, encoding, *[p.ravel().tolist() for p in planes])], "image_id int, width int, height int, encoding string, r array<double>, g array<double>, b array<double>")


def test_pixel_sources(spark):
    data = bytes([255, 0, 51, 0, 255, 102])
    df = spark.createDataFrame([(1, 2, 1, data)], "image_id int, width int, height int, data binary")
    row = images.from_rgb24(df).first()
    assert row["r"] == [1, 0] and row["b"] == pytest.approx([0.2, 0.4])
    ppm = spark.createDataFrame([(1, b"P6\n# note\n2 1\n255\n" + data)], "id int, content binary")
    assert images.load_bytes(ppm, "id", "content").first()["g"] == [0, 1]
    with pytest.raises(Exception, match="width"):
        images.from_rgb24(spark.createDataFrame([(1, 3, 1, data)], df.schema)).collect()


def test_image_files(spark, tmp_path):
    raw = bytes([255, 0, 0, 0, 0, 255])
    header = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    (tmp_path / "a.bmp").write_bytes(header + raw[2::-1] + raw[5:2:-1] + bytes(2))
    row = images.load_files(spark, str(tmp_path)).first()
    assert (row["width"], row["height"], row["r"], row["b"]) == (2, 1, [1, 0], [0, 1])


def png(kind, depth, w, h, raw):
    """A PNG of colour type ``kind`` from its rows' bytes."""
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    size = len(raw) // h
    lines = b"".join(b"\0" + raw[i * size : (i + 1) * size] for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, kind, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files_of_all_channels(spark, tmp_path):
    good = tmp_path / "good files"
    good.mkdir()
    (good / "grey.png").write_bytes(png(0, 8, 2, 1, bytes([51, 102])))
    (good / "grey alpha.png").write_bytes(png(4, 8, 2, 1, bytes([51, 9, 102, 0])))
    (good / "rgb.png").write_bytes(png(2, 8, 2, 1, bytes([255, 51, 0, 0, 102, 255])))
    (good / "rgba.png").write_bytes(png(6, 8, 2, 1, bytes([255, 51, 0, 128, 0, 102, 255, 0])))
    (good / "rgb16.png").write_bytes(png(2, 16, 1, 2, bytes([255, 255, 51, 51, 0, 0, 0, 0, 102, 102, 255, 255])))
    got = {r["image_id"].rsplit("/", 1)[1].replace("%20", " "): r for r in images.load_files(spark, str(good)).collect()}
    assert sorted(got) == sorted(f.name for f in good.iterdir())
    for name, r in got.items():
        want = ([0.2, 0.4],) * 3 if "grey" in name else ([1, 0], [0.2, 0.4], [0, 1])
        assert (r["r"], r["g"], r["b"]) == want, name
    for name, data in (("bad.png", b"no image"), ("deep.png", png(0, 16, 2, 1, bytes([51, 0, 102, 0])))):
        folder = tmp_path / name[:-4]
        folder.mkdir()
        (folder / name).write_bytes(data)
        with pytest.raises(Exception, match=name):
            images.load_files(spark, str(folder)).count()


def test_formats(spark):
    df = sheet(spark, [np.array([[0.2, 0.5]]), np.array([[0.1, 0.5]]), np.array([[0.9, 0.5]])], "srgb")
    byte = ops.convert(df, "rgb", "rgb24").first()
    assert byte["r"] == [51, 128] and byte["b"] == [230, 128]
    grey = ops.convert(df, "rgb", "gray", "linear").first()
    assert grey["encoding"] == "linear" and grey["value"][1] == pytest.approx(0.21404114, abs=1e-6)


def test_subtract_checks_sizes(spark):
    p = np.ones((2, 2))
    a = sheet(spark, [p, p, p]).selectExpr("image_id", "width", "height", "encoding", "r AS value")
    assert ops.subtract(a, a).first()["value"] == [0] * 4
    with pytest.raises(Exception, match="differ"):
        ops.subtract(a, a.withColumn("width", a["width"] + 1)).collect()


def test_forensics(spark):
    rng = random.Random(7)
    noisy = np.array([[(x + y) / 126 + rng.uniform(-0.04, 0.04) for x in range(64)] for y in range(64)])
    df = sheet(spark, [noisy, noisy * 0.9, 1 - noisy])
    for mode in forensics.MODES:
        a, b = (forensics.detect(df, forensics.DetectionOptions(mode=mode)).first() for _ in range(2))
        assert a == b and 0 <= a["score"] <= 1 and 0 <= a["confidence"] <= 1 and len(a["features"]) == 35
    assert [r["name"] for r in forensics.features(df).orderBy("place").collect()] == list(forensics.FEATURES)
    marked = images.with_metadata(df, spark.createDataFrame([(1, "Midjourney v6", None, None)], "image_id int, software string, creator_tool string, generator string"))
    row = forensics.detect(marked).first()
    assert row["features"][-2:] == [1, 1] and row["score"] > forensics.detect(df).first()["score"]
    case = forensics.robustness(df).first()
    assert case["minimum"] <= case["original"] <= case["maximum"] and case["stability"] == pytest.approx(1 - case["maximum"] + case["minimum"])


def test_camera_pattern_and_model(spark):
    rng = np.random.default_rng(3)
    planes = [rng.random((32, 32)) for _ in range(3)]
    df = sheet(spark, k.demosaic(k.to_bayer(*planes, "gbrg"), "gbrg"))
    row = forensics.camera_pattern(df).first()
    assert row["pattern"] in (None, *k.BAYER) and 0 <= row["confidence"] <= 1
    scored = forensics.with_model(forensics.detect(df), lambda x: x.sum(axis=1)).first()
    assert scored["model_score"] == pytest.approx(sum(scored["features"]))


def test_rows_of_images(spark):
    df = sheet(spark, [np.arange(6.0).reshape(2, 3)] * 3)
    assert ops.row(df, 1, "r").first()["row"] == [3, 4, 5]
    with pytest.raises(Exception, match="leaves the image"):
        ops.row(df, 2, "r").collect()


def test_noise_model_and_scores(spark):
    assert forensics.combine([(1, 0, 0.5), (0.5, 0.5, 0.2)]) == (0.5, 0.5)
    assert forensics.combine([]) == (0, 0)
    assert forensics.noise_model(np.zeros(10), np.zeros(10)) == (0, 0, 0)
    with pytest.raises(ValueError):
        forensics.DetectionOptions(threshold=2)


def test_composite_values(spark):
    df = spark.sql("SELECT named_struct('r', 250S, 'g', 3S) AS value")
    out = CompositePipeline(df).select(lambda p: {"r": to_byte(p.r + 10), "g": p.g / 2}).to_df().first()["value"]
    assert tuple(out) == (4, 1)
    with pytest.raises(Exception, match="1 to 16 fields"):
        describe(spark.sql("SELECT named_struct('a', 1.0D) AS v").schema["v"].dataType)
