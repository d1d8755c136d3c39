"""Image sources: raw RGB bytes, encoded files and packed arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.operators.packed import map_rows


def from_packed(df: DataFrame, image_id: str, values: str, width: int, height: int, encoding: str = "linear") -> DataFrame:
    """Grey images from an array column; rows of another length fail."""
    held = F.when(F.size(values) == width * height, F.col(values)).otherwise(F.raise_error(F.lit("pixels differ from width * height")))
    return df.select(F.col(image_id).alias("image_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(encoding).alias("encoding"), held.alias("value"))


def from_rgb24(df: DataFrame, encoding: str = "srgb", bgr: bool = False) -> DataFrame:
    """Planes r, g, b (0..1) from interleaved bytes in ``data`` of rows image_id,
    width, height."""
    order = (2, 1, 0) if bgr else (0, 1, 2)

    def run(w, h, data):
        raw = np.frombuffer(data, np.uint8)
        if raw.size != w * h * 3:
            raise ValueError("pixels differ from width * height * 3")
        return tuple(raw.reshape(-1, 3)[:, c] / 255 for c in order)

    made = map_rows(df, run, ["width", "height", "data"], ["image_id", "width", "height"], "r array<double>, g array<double>, b array<double>")
    return made.withColumn("encoding", F.lit(encoding))


def _deep_greys(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files whose grey samples may have 16 bits, by their first bytes."""
    head = F.hex(F.substring("content", 1, 26))
    png = F.substring(head, 1, 16).eqNullSafe("89504E470D0A1A0A") & (F.substring(head, 49, 2) == "10")
    tiff = F.substring(head, 1, 8).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B")
    return spark.read.format("binaryFile").load(path).where(png | tiff).select(F.col("_metadata.file_path").alias("file"), F.lit(True).alias("deep"))


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Decoded files (any codec of the JVM's ImageIO), id = path. Grey is spread over
    r, g and b, alpha is cut. Files that can't be decoded fail, and so do greys in 16-
    bit PNG and in TIFF, of whose samples Spark's reader keeps the low byte only."""

    def run(origin, w, h, channels, data, deep):
        if channels not in (1, 3, 4):
            raise ValueError(f"{origin} can't be decoded")
        if channels == 1 and deep:
            raise ValueError(f"{origin} may have grey samples of 16 bits")
        raw = np.frombuffer(data, np.uint8).reshape(h * w, channels)
        return tuple(raw[:, min(c, channels - 1)] / 255 for c in (2, 1, 0))

    image = [F.col(f"image.{x}").alias(y) for x, y in (("origin", "image_id"), ("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))]
    rows = spark.read.format("image").load(path).select(*image, F.col("_metadata.file_path").alias("file")).join(_deep_greys(spark, path), "file", "left").withColumn("deep", F.coalesce("deep", F.lit(False)))
    made = map_rows(rows, run, ["image_id", "width", "height", "channels", "data", "deep"], ["image_id", "width", "height"], "r array<double>, g array<double>, b array<double>")
    return made.withColumn("encoding", F.lit("srgb"))


def load_bytes(df: DataFrame, image_id: str, data: str) -> DataFrame:
    """Binary PPM and PGM (8 bit) from a column of file contents, as planes r, g, b."""

    def run(content):
        fields, at = [], 0
        while len(fields) < 4:
            while content[at : at + 1].isspace() or content[at : at + 1] == b"#":
                at = content.index(b"\n", at) + 1 if content[at : at + 1] == b"#" else at + 1
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(content[at:end])
            at = end
        w, h, most = map(int, fields[1:])
        channels = {b"P6": 3, b"P5": 1}[fields[0]]
        raw = np.frombuffer(content, np.uint8, w * h * channels, at + 1).reshape(-1, channels) / most
        return w, h, "srgb", *(raw[:, min(c, channels - 1)] for c in range(3))

    return map_rows(df.withColumnRenamed(image_id, "image_id"), run, [data], ["image_id"], "width int, height int, encoding string, r array<double>, g array<double>, b array<double>")


def grey_to_rgb(df: DataFrame) -> DataFrame:
    return df.select("image_id", "width", "height", "encoding", *[F.col("value").alias(c) for c in "rgb"])


def with_metadata(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Joins software, creator_tool, generator, camera_make and camera_model by id."""
    known = metadata.withColumn("has_metadata", F.lit(True))
    return images.join(known, "image_id", "left").withColumn("has_metadata", F.coalesce("has_metadata", F.lit(False)))
