"""Image operators on packed rows: pixel-wise ones as Columns over arrays, ones with
neighbours as Arrow kernels per image. No operator shuffles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.operators.image import kernels as k
from arraylume.operators.packed import map_rows

HEAD = ["image_id", "width", "height", "encoding"]
ENCODINGS = ("srgb", "linear")


# -- pixel-wise, built-in functions ------------------------------------------
def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def to_byte(v: Column) -> Column:
    """Half-to-even of v * 255, held in 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(v * 255))).cast("smallint")


def from_byte(v: Column) -> Column:
    return v.cast("double") / 255


def recode(v: Column, source: str, target: str) -> Column:
    if source not in ENCODINGS or target not in ENCODINGS:
        raise ValueError(f"an encoding is one of {', '.join(ENCODINGS)}")
    return v if source == target else srgb_to_linear(v) if source == "srgb" else linear_to_srgb(v)


def convert(df: DataFrame, source: str, target: str, target_encoding: str | None = None) -> DataFrame:
    """Pixel formats rgb24, rgb, gray8 and gray; a transfer function applies to each
    channel before luminance is taken. The image's encoding column says which."""
    names = {"rgb24": ("r", "g", "b"), "rgb": ("r", "g", "b"), "gray8": ("value",), "gray": ("value",)}
    if source not in names or target not in names:
        raise ValueError(f"a format is one of {', '.join(names)}")

    def channel(c):
        def one(v):
            v = from_byte(v) if source.endswith(("24", "8")) else v.cast("double")
            if target_encoding is None:
                return v
            if target_encoding not in ENCODINGS:
                raise ValueError(f"an encoding is one of {', '.join(ENCODINGS)}")
            other = srgb_to_linear(v) if target_encoding == "linear" else linear_to_srgb(v)
            return F.when(df["encoding"] == target_encoding, v).otherwise(other)

        return F.transform(c, one)

    planes = [channel(c) for c in names[source]]
    if target.startswith("gray") and len(planes) == 3:
        planes = [F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(planes, "rgb")]), lambda x: luminance(x["r"], x["g"], x["b"]))]
    elif target.startswith("rgb") and len(planes) == 1:
        planes = planes * 3
    finish = (lambda v: to_byte(v)) if target.endswith(("24", "8")) else (lambda v: v.cast("float"))
    encoding = F.col("encoding") if target_encoding is None else F.lit(target_encoding)
    return df.select("image_id", "width", "height", encoding.alias("encoding"), *[F.transform(p, finish).alias(n) for p, n in zip(planes, names[target])])


def checked(df: DataFrame, *planes: str) -> DataFrame:
    """Fails on rows whose planes don't hold width * height pixels."""
    for p in planes:
        df = df.withColumn(p, F.when(F.size(p) == F.col("width") * F.col("height"), F.col(p)).otherwise(F.raise_error(F.lit("pixels differ from width * height"))))
    return df


def combine_channels(r: Column, g: Column, b: Column) -> Column:
    """Three planes as one array of structs."""
    return F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))


def extract_channel(pixels, name: str) -> Column:
    return F.transform(pixels, lambda p: p[name])


def pixels(df: DataFrame, *planes: str) -> DataFrame:
    """Long rows image_id, x, y and the planes' values."""
    rows = df.select("image_id", "width", F.posexplode(F.arrays_zip(*planes)).alias("i", "p"))
    return rows.select("image_id", F.pmod("i", "width").cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[F.col("p")[p].alias(p) for p in planes])


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of images of equal id, size and encoding; others fail."""
    other = b.select("image_id", *[F.col(c).alias(f"_{c}") for c in (*HEAD[1:], "value")])
    same = (F.col("width") == F.col("_width")) & (F.col("height") == F.col("_height")) & (F.col("encoding") == F.col("_encoding"))
    value = F.when(same, F.zip_with("value", "_value", lambda x, y: x - y)).otherwise(F.raise_error(F.lit("images differ in size or encoding")))
    return a.join(other, "image_id").select(*HEAD, value.alias("value"))


# -- with neighbours, Arrow kernels -------------------------------------------
def plane_map(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], plane: str = "value") -> DataFrame:
    """The images with ``f`` of their plane; the size may change."""

    def run(width, height, values):
        if len(values) != width * height:
            raise ValueError("pixels differ from width * height")
        out = f(values.astype(float).reshape(height, width))
        return out.shape[1], out.shape[0], out

    made = map_rows(df, run, ["width", "height", plane], ["image_id", "encoding"], "width int, height int, value array<double>")
    return made.select(*HEAD, "value")


def plane_measure(df: DataFrame, f: Callable[[np.ndarray], tuple], outputs: str, plane: str = "value") -> DataFrame:
    """image_id and what ``f`` measures on its plane."""
    return map_rows(df, lambda w, h, v: f(v.astype(float).reshape(h, w)), ["width", "height", plane], ["image_id"], outputs)


def rgb_map(df: DataFrame, f: Callable[..., list], outputs: str = "r array<double>, g array<double>, b array<double>") -> DataFrame:
    """image head and what ``f(r, g, b)`` returns."""

    def run(w, h, r, g, b):
        return tuple(f(*(p.astype(float).reshape(h, w) for p in (r, g, b))))

    return map_rows(df, run, ["width", "height", "r", "g", "b"], HEAD, outputs)


def convolve2d(df, kernel, boundary: str = "clamp"):
    weights = np.asarray(kernel, float)
    return plane_map(df, lambda p: k.convolve2d(p, weights, boundary))


def box_blur(df, radius: int = 1):
    return plane_map(df, lambda p: k.box_blur(p, radius))


low_pass = box_blur


def residual(df, radius: int = 1):
    return plane_map(df, lambda p: k.residual(p, radius))


high_pass = residual


def gaussian_blur(df, radius: int = 1, sigma: float = 0.0):
    return plane_map(df, lambda p: k.gaussian_blur(p, radius, sigma))


def gradient_x(df):
    return plane_map(df, k.gradient_x)


def gradient_y(df):
    return plane_map(df, k.gradient_y)


def sobel(df):
    return plane_map(df, k.gradient_magnitude)


def laplacian(df):
    return plane_map(df, k.laplacian)


def edge_map(df, threshold: float):
    return plane_map(df, lambda p: k.edge_map(p, threshold))


def sharpen(df, amount: float):
    return plane_map(df, lambda p: k.sharpen(p, amount))


def local_contrast(df, radius: int = 1):
    return plane_map(df, lambda p: k.local_contrast(p, radius))


def local_entropy(df, radius: int = 1, bins: int = 64):
    return plane_map(df, lambda p: k.local_entropy(p, radius, bins))


def entropy(df, bins: int = 64):
    return plane_measure(df, lambda p: (k.entropy(p, bins),), "entropy double")


def spatial_correlation(df, dx: int, dy: int):
    return plane_measure(df, lambda p: (k.spatial_correlation(p, dx, dy),), "value double")


def crop(df, x: int, y: int, width: int, height: int):
    return plane_map(df, lambda p: k.crop(p, x, y, width, height))


def resize(df, width: int, height: int):
    return plane_map(df, lambda p: k.resize(p, width, height))


def downsample(df, width: int, height: int):
    return plane_map(df, lambda p: k.downsample(p, width, height))


def downsample_by(df, scale: float):
    return plane_map(df, lambda p: k.downsample(p, *k.scaled_size(p.shape[1], p.shape[0], scale)))


def spectrum_input(df, width: int, height: int):
    return plane_map(df, lambda p: k.spectrum_input(p, width, height))


def window2d(df, window: str = "hann"):
    return plane_map(df, lambda p: k.window2d(p, window))


def power_spectrum2d(df):
    return plane_map(df, k.power_spectrum2d)


def radial_spectrum(df, bins: int, low: float = 0.15, middle: float = 0.5):
    """Rings and band energies of a power spectrum."""
    return plane_measure(df, lambda p: (lambda s, e: (s, *map(float, e)))(*k.radial_spectrum(p, bins, low, middle)), "spectrum array<double>, low double, middle double, high double")


def band_energy(df, low: float = 0.15, middle: float = 0.5):
    return radial_spectrum(df, 1, low, middle).drop("spectrum")


def peak_metrics(df, strong: float = 8.0):
    return plane_measure(df, lambda p: k.peak_metrics(p, strong), "max_ratio double, strong_count int")


def to_bayer(df, pattern: str = "rggb"):
    return rgb_map(df, lambda r, g, b: [k.to_bayer(r, g, b, pattern)], "value array<double>")


def demosaic(df, pattern: str = "rggb"):
    return map_rows(df, lambda w, h, v: tuple(k.demosaic(v.astype(float).reshape(h, w), pattern)), ["width", "height", "value"], HEAD, "r array<double>, g array<double>, b array<double>")


def parity_means(df):
    return plane_measure(df, lambda p: tuple(float(s.mean()) if s.size else 0.0 for s in k.parity_samples(p)), "p0 double, p1 double, p2 double, p3 double")


def parity_samples(df):
    """The pixels at each parity 2 * (y & 1) + (x & 1), row by row."""
    return plane_measure(df, lambda p: tuple(k.parity_samples(p)), "p0 array<double>, p1 array<double>, p2 array<double>, p3 array<double>")


def row(df, y: int, plane: str = "value"):
    """Row y of each image as an array; built-in functions only."""
    inside = (F.lit(y) >= 0) & (F.lit(y) < F.col("height"))
    part = F.slice(plane, F.lit(y) * F.col("width") + 1, F.col("width"))
    return df.select("image_id", F.when(inside, part).otherwise(F.raise_error(F.lit("the row leaves the image"))).alias("row"))


def rgb_correlations(df):
    return rgb_map(df, lambda r, g, b: [np.array(x) for x in k.rgb_correlations(r, g, b)], "channels array<double>, neighbours array<double>")


def cfa_parity_residuals(df):
    return rgb_map(df, lambda r, g, b: [k.cfa_parity_residuals(r, g, b)], "residuals array<double>")


def signal_noise(df, a: float, b: float, seed: int = 1):
    return plane_map(df, lambda p: k.signal_noise(p, a, b, seed))


def shot_noise(df, scale: float, seed: int = 1):
    return plane_map(df, lambda p: k.shot_noise(p, scale, seed))


def read_noise(df, deviation: float, seed: int = 1):
    return plane_map(df, lambda p: k.read_noise(p, deviation, seed))


def simulate_camera(df, **options):
    return rgb_map(df, lambda r, g, b: k.simulate_camera(r, g, b, **options))
