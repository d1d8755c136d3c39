"""Queries of the image operators. The images are the 64 values of an embedding as 8
by 8 grey pixels, moved into about 0..1, and three planes made of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from arraylume.operators import forensics
from arraylume.operators.image import kernels, ops
from arraylume.plans.catalog_base import Catalog, table
from arraylume.sources import images

CATALOG = Catalog()
add = CATALOG.add


def _grey(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 0.55).alias("value"))
    return images.from_packed(df, "vec_id", "value", 8, 8)


def _rgb(spark, sf):
    v = F.col("value")
    return _grey(spark, sf).select(*ops.HEAD, v.alias("r"), F.transform(v, lambda x: x * 0.5 + 0.2).alias("g"), F.transform(v, lambda x: 1 - x * x).alias("b"))


_PX = "px AS (SELECT vec_id AS image_id, ((i - 1) % 8)::INTEGER AS x, ((i - 1) // 8)::INTEGER AS y, embedding[i]::DOUBLE + 0.55 AS v FROM embeddings, range(1, 65) AS r(i))"
_RGB = "rgb AS (SELECT image_id, x, y, v AS r, v * 0.5 + 0.2 AS g, 1 - v * v AS b FROM px)"


def _pixels(df, digits: int = 5):
    return ops.pixels(df, "value").select("image_id", "x", "y", (F.round("value", digits) + 0.0).alias("value"))


# Weights of the SQL, apart from those of the operators.
_SOBEL_X = [[-0.125, 0, 0.125], [-0.25, 0, 0.25], [-0.125, 0, 0.125]]
_SOBEL_Y = [[-0.125, -0.25, -0.125], [0, 0, 0], [0.125, 0.25, 0.125]]
_LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def _gauss(r: int, sigma: float) -> list[list[float]]:
    line = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [[p * q / sum(line) ** 2 for q in line] for p in line]


def _conv(kernel, source: str = "px") -> str:
    """SQL of a correlation with edges held."""
    k = np.asarray(kernel, float)
    ry, rx = k.shape[0] // 2, k.shape[1] // 2
    rows = ", ".join(f"({j - rx}, {i - ry}, {float(k[i, j])!r}::DOUBLE)" for i in range(k.shape[0]) for j in range(k.shape[1]))
    return f"(SELECT p.image_id, p.x, p.y, any_value(p.v) AS c, sum(k.w * q.v) AS v FROM {source} p CROSS JOIN (VALUES {rows}) k(dx, dy, w) JOIN {source} q ON q.image_id = p.image_id AND q.x = greatest(0, least(7, p.x + k.dx)) AND q.y = greatest(0, least(7, p.y + k.dy)) GROUP BY p.image_id, p.x, p.y)"


def _near(r: int, value: str) -> str:
    """SQL of an aggregate over the clipped window."""
    return f"(SELECT p.image_id, p.x, p.y, any_value(p.v) AS c, {value} AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - {r} AND p.x + {r} AND q.y BETWEEN p.y - {r} AND p.y + {r} GROUP BY p.image_id, p.x, p.y)"


def _plane(name: str, make, source: str, value: str = "v", digits: int = 5) -> None:
    """A grey-to-grey operator; SQL as a source with image_id, x, y and v."""
    add(name, f"WITH {_PX} SELECT image_id, x::INTEGER AS x, y::INTEGER AS y, round({value}, {digits}) + 0.0 AS value FROM {source}")(lambda spark, sf: _pixels(make(_grey(spark, sf)), digits))


_plane("image_convolve2d", lambda d: ops.convolve2d(d, [[0, 1, 2], [1, -3, 0], [0.5, 0, 1]]), _conv([[0, 1, 2], [1, -3, 0], [0.5, 0, 1]]))
_plane("image_box_blur", lambda d: ops.box_blur(d, 2), _near(2, "avg(q.v)"))
_plane("image_low_pass", lambda d: ops.low_pass(d, 1), _near(1, "avg(q.v)"))
_plane("image_residual", lambda d: ops.residual(d, 1), _near(1, "any_value(p.v) - avg(q.v)"))
_plane("image_high_pass", lambda d: ops.high_pass(d, 2), _near(2, "any_value(p.v) - avg(q.v)"))
_plane("image_gaussian_blur", lambda d: ops.gaussian_blur(d, 2), _conv(_gauss(2, 1.0)))
_plane("image_gradient_x", ops.gradient_x, _conv(_SOBEL_X))
_plane("image_gradient_y", ops.gradient_y, _conv(_SOBEL_Y))
_SLOPE = f"(SELECT image_id, x, y, sqrt(a.v * a.v + b.v * b.v) AS v FROM {_conv(_SOBEL_X)} a JOIN {_conv(_SOBEL_Y)} b USING (image_id, x, y))"
_plane("image_sobel", ops.sobel, _SLOPE)
_plane("image_edge_map", lambda d: ops.edge_map(d, 0.08), _SLOPE, "CASE WHEN v >= 0.08 THEN 1 ELSE 0 END::DOUBLE")
_plane("image_laplacian", ops.laplacian, _conv(_LAPLACE))
_plane("image_sharpen", lambda d: ops.sharpen(d, 0.4), _conv(_LAPLACE), "c - 0.4 * v")
_plane("image_local_contrast", lambda d: ops.local_contrast(d, 1), _near(1, "max(q.v) - min(q.v)"))
_plane("image_local_entropy", lambda d: ops.local_entropy(d, 1, 16), "(SELECT image_id, x, y, -sum(p * log2(p)) AS v FROM (SELECT image_id, x, y, n / sum(n) OVER (PARTITION BY image_id, x, y) AS p FROM (SELECT p.image_id, p.x, p.y, least(15, trunc(greatest(0, least(1, q.v)) * 16)) AS bin, count(*) AS n FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)) GROUP BY image_id, x, y)")
_plane("image_crop", lambda d: ops.crop(d, 2, 1, 4, 5), "(SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5)")
_plane("image_downsample", lambda d: ops.downsample(d, 3, 5), "(SELECT p.image_id, dx AS x, dy AS y, avg(v) AS v FROM px p, range(3) AS a(dx), range(5) AS b(dy) WHERE x >= dx * 8 // 3 AND x < (dx + 1) * 8 // 3 AND y >= dy * 8 // 5 AND y < (dy + 1) * 8 // 5 GROUP BY ALL)")
_plane("image_downsample_scale", lambda d: ops.downsample_by(d, 0.5), "(SELECT image_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM px GROUP BY ALL)")
_plane("image_resize", lambda d: ops.resize(d, 5, 6), """(SELECT g.image_id, g.x, g.y, sum(q.v * greatest(0, 1 - abs(q.x - g.sx)) * greatest(0, 1 - abs(q.y - g.sy))) AS v
 FROM (SELECT image_id, a AS x, b AS y, a * 7 / 4.0::DOUBLE AS sx, b * 7 / 5.0::DOUBLE AS sy FROM (SELECT DISTINCT image_id FROM px), range(5) AS r(a), range(6) AS s(b)) g
 JOIN px q ON q.image_id = g.image_id AND abs(q.x - g.sx) < 1 AND abs(q.y - g.sy) < 1 GROUP BY ALL)""")
_HANN = "(0.5 - 0.5 * cos(2 * pi() * {0} / {1}))"
_plane("image_window2d", ops.window2d, "px", f"v * {_HANN.format('x', 7)} * {_HANN.format('y', 7)}")
_plane("image_spectrum_input", lambda d: ops.spectrum_input(d, 4, 4), "(SELECT image_id, x - 2 AS x, y - 2 AS y, v - avg(v) OVER (PARTITION BY image_id) AS v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)", f"v * {_HANN.format('x', 3)} * {_HANN.format('y', 3)}")


@add("image_subtract", f"WITH {_PX} SELECT image_id, x, y, round(v - v / 2, 6) AS value FROM px")
def image_subtract(spark, sf):
    a = _grey(spark, sf)
    return ops.pixels(ops.subtract(a, a.withColumn("value", F.transform("value", lambda v: v / 2))), "value").select("image_id", "x", "y", F.round("value", 6).alias("value"))


@add("image_entropy", f"WITH {_PX} SELECT image_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM (SELECT image_id, least(63, greatest(0, trunc(v * 64))) AS bin, count(*) AS n FROM px GROUP BY ALL)) GROUP BY image_id")
def image_entropy(spark, sf):
    return ops.entropy(_grey(spark, sf), 64).select("image_id", F.round("entropy", 6).alias("entropy"))


for _dx, _dy in ((1, 0), (2, -1)):
    add(f"image_spatial_correlation_{_dx}_{abs(_dy)}", f"WITH {_PX} SELECT p.image_id, round(corr(p.v, q.v), 6) AS value FROM px p JOIN px q ON q.image_id = p.image_id AND q.x = p.x + {_dx} AND q.y = p.y + ({_dy}) GROUP BY p.image_id")(
        lambda spark, sf, dx=_dx, dy=_dy: ops.spatial_correlation(_grey(spark, sf), dx, dy).select("image_id", F.round("value", 6).alias("value"))
    )

_POWER = f"""WITH {_PX},
 t AS (SELECT m, cos(2 * pi() * m / 8) AS c, sin(2 * pi() * m / 8) AS s FROM range(8) AS r(m)),
 f AS (SELECT image_id, u, w, sum(v * c) AS re, sum(v * s) AS im FROM px, range(8) AS a(u), range(8) AS b(w) JOIN t ON m = (u * x + w * y) % 8 GROUP BY image_id, u, w),
 pw AS (SELECT image_id, u::INTEGER AS x, w::INTEGER AS y, re * re + im * im AS v, (sqrt((CASE WHEN u <= 4 THEN u ELSE u - 8 END) ** 2 + (CASE WHEN w <= 4 THEN w ELSE w - 8 END) ** 2) / sqrt(32))::FLOAT AS radius FROM f)"""


@add("image_radial_spectrum", f"{_POWER}, m AS (SELECT image_id, least(11, trunc(radius * 12::FLOAT))::INTEGER AS bin, avg(v) AS m FROM pw GROUP BY ALL), t2 AS (SELECT image_id, sum(m) AS t FROM m GROUP BY image_id) SELECT i.image_id, b::INTEGER AS bin, round(coalesce(m / t, 0), 6) AS value FROM t2 i CROSS JOIN range(12) AS r(b) LEFT JOIN m ON m.image_id = i.image_id AND m.bin = b")
def image_radial_spectrum(spark, sf):
    power = ops.power_spectrum2d(_grey(spark, sf))
    return ops.radial_spectrum(power, 12).select("image_id", F.posexplode("spectrum").alias("bin", "v")).select("image_id", "bin", F.round("v", 6).alias("value"))


@add("image_band_energy", f"{_POWER} SELECT image_id, round(coalesce(sum(v) FILTER (radius < 0.15::FLOAT), 0), 4) AS low, round(coalesce(sum(v) FILTER (radius >= 0.15::FLOAT AND radius < 0.5), 0), 4) AS middle, round(sum(v) FILTER (radius >= 0.5), 4) AS high FROM pw GROUP BY image_id")
def image_band_energy(spark, sf):
    return ops.band_energy(ops.power_spectrum2d(_grey(spark, sf))).select("image_id", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])


_RING = np.full((5, 5), 1 / 24)
_RING[2, 2] = 0


@add("image_peak_metrics", f"WITH {_PX} SELECT image_id, round(least(max(c / greatest(v, 1e-30)), 1000), 5) AS max_ratio, count(*) FILTER (c / greatest(v, 1e-30) >= 1.5)::INTEGER AS strong_count FROM {_conv(_RING)} GROUP BY image_id")
def image_peak_metrics(spark, sf):
    return ops.peak_metrics(_grey(spark, sf), 1.5).select("image_id", F.round("max_ratio", 5).alias("max_ratio"), "strong_count")


# -- colour -----------------------------------------------------------------------
_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_SRGB = "CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow(greatest({0}, 0.0031308), 1 / 2.4::DOUBLE) - 0.055 END"


@add("image_srgb_to_linear", f"WITH {_PX} SELECT image_id, x, y, round({_LIN.format('v')}, 6) AS value FROM px")
def image_srgb_to_linear(spark, sf):
    df = _grey(spark, sf).withColumn("value", F.transform("value", ops.srgb_to_linear))
    return ops.pixels(df, "value").select("image_id", "x", "y", F.round("value", 6).alias("value"))


@add("image_linear_to_srgb", f"WITH {_PX} SELECT image_id, x, y, round({_SRGB.format('v')}, 6) AS value FROM px")
def image_linear_to_srgb(spark, sf):
    df = _grey(spark, sf).withColumn("value", F.transform("value", ops.linear_to_srgb))
    return ops.pixels(df, "value").select("image_id", "x", "y", F.round("value", 6).alias("value"))


@add("image_luminance", f"WITH {_PX}, {_RGB} SELECT image_id, x, y, round((0.2126 * r + 0.7152 * g + 0.0722 * b)::FLOAT::DOUBLE, 4) AS value FROM rgb")
def image_luminance(spark, sf):
    df = ops.convert(_rgb(spark, sf), "rgb", "gray")
    return ops.pixels(df, "value").select("image_id", "x", "y", F.round(F.col("value").cast("double"), 4).alias("value"))


_BYTE = "greatest(0, least(255, round_even(({}) * 255, 0)))::SMALLINT"


@add("image_quantize_rgb24", f"WITH {_PX}, {_RGB} SELECT image_id, x, y, {_BYTE.format('r')} AS r, {_BYTE.format('g')} AS g, {_BYTE.format('b')} AS b FROM rgb")
def image_quantize(spark, sf):
    return ops.pixels(ops.convert(_rgb(spark, sf), "rgb", "rgb24"), "r", "g", "b")


@add("image_gray8_from_bytes", f"WITH {_PX}, {_RGB}, q AS (SELECT image_id, x, y, {_BYTE.format('r')} / 255.0::DOUBLE AS r, {_BYTE.format('g')} / 255.0::DOUBLE AS g, {_BYTE.format('b')} / 255.0::DOUBLE AS b FROM rgb) SELECT image_id, x, y, {_BYTE.format('0.2126 * r + 0.7152 * g + 0.0722 * b')} AS value FROM q")
def image_gray8(spark, sf):
    return ops.pixels(ops.convert(ops.convert(_rgb(spark, sf), "rgb", "rgb24"), "rgb24", "gray8"), "value")


@add("image_gray_to_srgb", f"WITH {_PX} SELECT image_id, x, y, round(({_SRGB.format('v')})::FLOAT::DOUBLE, 4) AS r FROM px")
def image_recode(spark, sf):
    df = ops.convert(_grey(spark, sf), "gray", "rgb", "srgb")
    return ops.pixels(df, "r").select("image_id", "x", "y", F.round(F.col("r").cast("double"), 4).alias("r"))


@add("image_channels", f"WITH {_PX}, {_RGB} SELECT image_id, x, y, round(g, 6) AS g FROM rgb")
def image_channels(spark, sf):
    packed = _rgb(spark, sf).withColumn("pixels", ops.combine_channels(F.col("r"), F.col("g"), F.col("b")))
    df = packed.select("image_id", "width", ops.extract_channel("pixels", "g").alias("g"))
    return ops.pixels(df, "g").select("image_id", "x", "y", F.round("g", 6).alias("g"))


# -- sensor mosaics -----------------------------------------------------------------
def _mosaic(pattern: str) -> str:
    names = [("r", "g", "b")[c] for c in kernels.BAYER[pattern]]
    return f"CASE 2 * (y % 2) + x % 2 WHEN 0 THEN {names[0]} WHEN 1 THEN {names[1]} WHEN 2 THEN {names[2]} ELSE {names[3]} END"


for _p in kernels.BAYER:
    add(f"image_to_bayer_{_p}", f"WITH {_PX}, {_RGB} SELECT image_id, x, y, round({_mosaic(_p)}, 6) AS value FROM rgb")(
        lambda spark, sf, p=_p: ops.pixels(ops.to_bayer(_rgb(spark, sf), p), "value").select("image_id", "x", "y", F.round("value", 6).alias("value"))
    )
_CELL = "CASE 2 * (q.y % 2) + q.x % 2 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END"
#: The 3 by 3 cells (edges held) of each pixel of a mosaic m, with their channel.
_CELLS = f"SELECT p.image_id, p.x, p.y, q.v, {_CELL} AS c FROM m p CROSS JOIN (SELECT i - 1 AS dx, j - 1 AS dy FROM range(3) AS r(i), range(3) AS s(j)) k JOIN m q ON q.image_id = p.image_id AND q.x = greatest(0, least(7, p.x + dx)) AND q.y = greatest(0, least(7, p.y + dy))"


@add("image_demosaic", f"""WITH {_PX}, {_RGB}, m AS (SELECT image_id, x, y, {_mosaic('grbg')} AS v FROM rgb),
 n AS ({_CELLS})
SELECT image_id, x, y, round(coalesce(avg(v) FILTER (c = 0), 0), 6) AS r, round(coalesce(avg(v) FILTER (c = 1), 0), 6) AS g, round(coalesce(avg(v) FILTER (c = 2), 0), 6) AS b FROM n GROUP BY image_id, x, y""")
def image_demosaic(spark, sf):
    out = ops.demosaic(ops.to_bayer(_rgb(spark, sf), "grbg"), "grbg")
    return ops.pixels(out, "r", "g", "b").select("image_id", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


@add("image_parity_means", f"WITH {_PX} SELECT image_id, {', '.join(f'round(avg(v) FILTER (2 * (y % 2) + x % 2 = {p}), 6) AS p{p}' for p in range(4))} FROM px GROUP BY image_id")
def image_parity_means(spark, sf):
    return ops.parity_means(_grey(spark, sf)).select("image_id", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in range(4)])


@add("image_parity_samples", f"WITH {_PX} SELECT image_id, (2 * (y % 2) + x % 2)::INTEGER AS parity, ((y // 2) * 4 + x // 2)::INTEGER AS i, round(v, 6) AS value FROM px")
def image_parity_samples(spark, sf):
    groups = ops.parity_samples(_grey(spark, sf)).select("image_id", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("parity", "group"))
    return groups.select("image_id", "parity", F.posexplode("group").alias("i", "v")).select("image_id", "parity", "i", F.round("v", 6).alias("value"))


@add("image_row", f"WITH {_PX} SELECT image_id, x, round(v, 6) AS value FROM px WHERE y = 3")
def image_row(spark, sf):
    return ops.row(_grey(spark, sf), 3).select("image_id", F.posexplode("row").alias("x", "v")).select("image_id", "x", F.round("v", 6).alias("value"))


@add("image_rgb_correlations", f"""WITH {_PX}, {_RGB}
SELECT p.image_id, round(corr(p.r, p.b), 6) AS rb, round(corr(p.r, r.g), 6) AS r_right, round(corr(p.r, d.g), 6) AS r_down, round(corr(p.b, r.g), 6) AS b_right, round(corr(p.b, d.g), 6) AS b_down
FROM rgb p LEFT JOIN rgb r ON r.image_id = p.image_id AND r.x = p.x + 1 AND r.y = p.y LEFT JOIN rgb d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y + 1 GROUP BY p.image_id""")
def image_rgb_correlations(spark, sf):
    n, c = F.col("neighbours"), F.col("channels")
    return ops.rgb_correlations(_rgb(spark, sf)).select("image_id", F.round(c[1], 6).alias("rb"), *[F.round(n[i], 6).alias(a) for i, a in enumerate(("r_right", "r_down", "b_right", "b_down"))])


@add("image_cfa_parity_residuals", f"""WITH {_PX}, {_RGB},
 n AS (SELECT p.image_id, 2 * (p.y % 2) + p.x % 2 AS parity, abs(p.r - (l.r + r.r + u.r) / 3) AS dr, abs(p.g - (l.g + r.g + u.g) / 3) AS dg, abs(p.b - (l.b + r.b + u.b) / 3) AS db FROM rgb p JOIN rgb l ON l.image_id = p.image_id AND l.y = p.y AND l.x = greatest(0, p.x - 1) JOIN rgb r ON r.image_id = p.image_id AND r.y = p.y AND r.x = least(7, p.x + 1) JOIN rgb u ON u.image_id = p.image_id AND u.x = p.x AND u.y = greatest(0, p.y - 1))
SELECT image_id, parity::INTEGER AS parity, round(avg(dr), 6) AS red, round(avg(dg), 6) AS green, round(avg(db), 6) AS blue FROM n GROUP BY image_id, parity""")
def image_cfa(spark, sf):
    rows = ops.cfa_parity_residuals(_rgb(spark, sf)).select("image_id", "residuals", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("parity"))
    return rows.select("image_id", "parity", *[F.round(F.get("residuals", F.col("parity") * 3 + c), 6).alias(n) for c, n in enumerate(("red", "green", "blue"))])


@add("image_rgb24_source", f"WITH {_PX}, {_RGB} SELECT image_id, x, y, round({_BYTE.format('g')} / 255.0::DOUBLE, 6) AS g FROM rgb")
def image_rgb24_source(spark, sf):
    import pyarrow as pa

    quantised = ops.convert(_rgb(spark, sf), "rgb", "rgb24")

    def to_bytes(batches):
        for batch in batches:
            planes = [batch.column(i) for i in (3, 4, 5)]
            data = [np.stack([p[i].values.to_numpy() for p in planes], axis=1).astype(np.uint8).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["image_id", "width", "height", "data"])

    raw = quantised.select("image_id", "width", "height", "r", "g", "b").mapInArrow(to_bytes, "image_id long, width int, height int, data binary")
    return ops.pixels(images.from_rgb24(raw), "g").select("image_id", "x", "y", F.round("g", 6).alias("g"))


# -- noise, camera, forensics: seeded generators and long compositions ----------------
def _normals(seed: int) -> str:
    """SQL of z (i, z): 64 normals from the subtractive generator, step by step."""
    return f"""seeded(i, v, later) AS (SELECT 0, 161803398 - {seed}::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, later, (v - later + 2147483647) % 2147483647 FROM seeded WHERE i < 54),
 mixed(n, s) AS (SELECT 0, list(v ORDER BY CASE i WHEN 0 THEN 55 ELSE 21 * i % 55 END) FROM seeded
  UNION ALL SELECT n + 1, s[1:n % 55] || [(s[n % 55 + 1] - s[1 + (n % 55 + 31) % 55] + 2147483647) % 2147483647] || s[n % 55 + 2:55] FROM mixed WHERE n < 220),
 drawn(k, s) AS (SELECT 0, s FROM mixed WHERE n = 220 UNION ALL SELECT k + 1, s[2:55] || [(s[1] - s[22] + 2147483647) % 2147483647] FROM drawn WHERE k < 64),
 u AS (SELECT k - 1 AS i, s[55] / 2147483647::DOUBLE AS u FROM drawn WHERE k > 0),
 z AS (SELECT f.i + j AS i, sqrt(-2 * ln(f.u)) * CASE j WHEN 0 THEN cos(2 * pi() * t.u) ELSE sin(2 * pi() * t.u) END AS z FROM u f JOIN u t ON f.i % 2 = 0 AND t.i = f.i + 1, range(2) AS r(j))"""


def _noisy(a: str, b: str, source: str = "px") -> str:
    return f"(SELECT image_id, x, y, greatest(0, least(1, v + sqrt(greatest(0, {a} * v + {b})) * z)) AS v FROM {source} JOIN z ON i = 8 * y + x)"


def _noise_sql(a: str, b: str, seed: int) -> str:
    return f"WITH RECURSIVE {_PX}, {_normals(seed)} SELECT image_id, x, y, round(v, 5) + 0.0 AS value FROM {_noisy(a, b)}"


@add("image_signal_noise", _noise_sql("0.002::DOUBLE", "0.0001::DOUBLE", 42))
def image_signal_noise(spark, sf):
    return _pixels(ops.signal_noise(_grey(spark, sf), 0.002, 0.0001, 42))


@add("image_shot_noise", _noise_sql("0.002::DOUBLE", "0", 7))
def image_shot_noise(spark, sf):
    return _pixels(ops.shot_noise(_grey(spark, sf), 0.002, 7))


@add("image_read_noise", _noise_sql("0", "0.01::DOUBLE * 0.01", 7))
def image_read_noise(spark, sf):
    return _pixels(ops.read_noise(_grey(spark, sf), 0.01, 7))


@add("image_simulate_camera", f"""
WITH RECURSIVE {_PX}, {_RGB}, {_normals(1)},
 blurred AS (SELECT image_id, x, y, p.v AS r, q.v AS g, s.v AS b FROM {_conv(_gauss(1, 0.5), '(SELECT image_id, x, y, r AS v FROM rgb)')} p JOIN {_conv(_gauss(1, 0.5), '(SELECT image_id, x, y, g AS v FROM rgb)')} q USING (image_id, x, y) JOIN {_conv(_gauss(1, 0.5), '(SELECT image_id, x, y, b AS v FROM rgb)')} s USING (image_id, x, y)),
 clean AS (SELECT image_id, x, y, {_mosaic('grbg')} AS v FROM blurred),
 m AS {_noisy("0.001::DOUBLE", "0.0005::DOUBLE * 0.0005", "clean")},
 n AS ({_CELLS}),
 d AS (SELECT image_id, x, y, c, avg(v) AS v FROM n GROUP BY ALL),
 sharp AS (SELECT image_id, x, y, 0 AS c0, c - 0.15 * v AS v FROM {_conv(_LAPLACE, '(SELECT image_id, x, y, v FROM d WHERE c = 0)')}
  UNION ALL SELECT image_id, x, y, 1, c - 0.15 * v FROM {_conv(_LAPLACE, '(SELECT image_id, x, y, v FROM d WHERE c = 1)')}
  UNION ALL SELECT image_id, x, y, 2, c - 0.15 * v FROM {_conv(_LAPLACE, '(SELECT image_id, x, y, v FROM d WHERE c = 2)')})
SELECT image_id, x, y, {', '.join(f'round(greatest(0, least(1, any_value(v) FILTER (c0 = {i}))), 5) AS {c}' for i, c in enumerate('rgb'))} FROM sharp GROUP BY image_id, x, y""")
def image_simulate_camera(spark, sf):
    out = ops.simulate_camera(_rgb(spark, sf), pattern="grbg", blur=0.5, shot=0.001, read=0.0005, sharpening=0.15)
    return ops.pixels(out, "r", "g", "b").select("image_id", "x", "y", *[F.round(c, 5).alias(c) for c in "rgb"])


@add("forensic_features")
def forensic_features(spark, sf):
    return forensics.features(_rgb(spark, sf)).select("image_id", "place", "name", F.round("value", 5).alias("value"))


def _scores(mode: str):
    return lambda spark, sf: forensics.detect(_rgb(spark, sf), forensics.DetectionOptions(mode=mode)).select("image_id", F.round("score", 5).alias("score"), F.round("confidence", 5).alias("confidence"), "is_likely_ai")


for _mode in forensics.MODES:
    add(f"forensic_detect_{_mode}")(_scores(_mode))


@add("forensic_noise_statistics", f"""WITH {_PX}, {_RGB}, lum AS (SELECT image_id, x, y, 0.2126 * r + 0.7152 * g + 0.0722 * b AS v FROM rgb),
 res AS (SELECT p.image_id, p.x, p.y, any_value(p.v) - avg(q.v) AS v FROM lum p JOIN lum q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.x, p.y)
SELECT image_id, round(var_pop(v), 7) AS variance, round(kurtosis_pop(v), 5) AS kurtosis FROM res GROUP BY image_id""")
def forensic_noise(spark, sf):
    f = F.col("features")
    return forensics.detect(_rgb(spark, sf)).select("image_id", F.round(f[1], 7).alias("variance"), F.round(f[4], 5).alias("kurtosis"))


@add("forensic_spatial_statistics", f"""WITH {_PX}, {_RGB}, lum AS (SELECT image_id, x, y, 0.2126 * r + 0.7152 * g + 0.0722 * b AS v FROM rgb),
 lap AS (SELECT image_id, var_pop(v) AS lv FROM {_conv(_LAPLACE, 'lum')} GROUP BY image_id),
 slope AS (SELECT image_id, avg(v) AS gm, avg(CASE WHEN v >= 0.08 THEN 1 ELSE 0 END) AS ed FROM (SELECT image_id, x, y, sqrt(a.v * a.v + b.v * b.v) AS v FROM {_conv(_SOBEL_X, 'lum')} a JOIN {_conv(_SOBEL_Y, 'lum')} b USING (image_id, x, y)) GROUP BY image_id)
SELECT image_id, round(lv, 6) AS laplacian_variance, round(gm, 6) AS gradient_mean, round(ed, 6) AS edge_density FROM lap JOIN slope USING (image_id)""")
def forensic_spatial(spark, sf):
    f = F.col("features")
    at = forensics.FEATURES.index
    names = ("laplacian_variance", "gradient_mean", "edge_density")
    return forensics.detect(_rgb(spark, sf)).select("image_id", *[F.round(f[at(f"spatial.{n}")], 6).alias(n) for n in names])


@add("forensic_camera_pattern")
def forensic_camera_pattern(spark, sf):
    return forensics.camera_pattern(_rgb(spark, sf)).select("image_id", "pattern", F.round("score", 5).alias("score"), F.round("confidence", 5).alias("confidence"))


@add("forensic_combine_scores", "SELECT user_id AS image_id, coalesce(round(least(1, sum(s * c * w) FILTER (c > 0 AND w > 0) / sum(c * w) FILTER (c > 0 AND w > 0)), 6), 0) AS score, coalesce(round(least(1, sum(c * w) FILTER (c > 0 AND w > 0) / sum(w) FILTER (c > 0 AND w > 0)), 6), 0) AS confidence FROM (SELECT user_id, (event_id % 10) / 10.0::DOUBLE AS s, (event_id % 7) / 7.0::DOUBLE AS c, (event_id % 3) / 4.0::DOUBLE AS w FROM events) GROUP BY user_id")
def forensic_combine(spark, sf):
    part = lambda n, d: ((F.col("event_id") % n) / d).cast("double")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("image_id"), part(10, 10).alias("score"), part(7, 7).alias("confidence"), part(3, 4).alias("weight"))
    return forensics.combined_score(rows).select("image_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@add("forensic_metadata_markers", "SELECT page_id, (contains(t, 'dalle') OR contains(t, 'firefly') OR contains(t, 'midjourney') OR contains(t, 'comfyui') OR contains(t, 'dall-e') OR contains(t, 'invokeai') OR contains(t, 'automatic1111') OR contains(t, 'stable diffusion') OR contains(t, 'generative fill')) AS explicit FROM (SELECT page_id, lower(concat_ws(' ', url, CASE page_id % 5 WHEN 0 THEN 'DALLE 3' WHEN 1 THEN 'FireFly' END)) AS t FROM pages)")
def forensic_metadata(spark, sf):
    tool = F.when(F.col("page_id") % 5 == 0, "DALLE 3").when(F.col("page_id") % 5 == 1, "FireFly")
    return table(spark, sf, "pages").select("page_id", forensics.explicit_marker(F.col("url"), tool).alias("explicit"))


@add("forensic_robustness")
def forensic_robustness(spark, sf):
    out = forensics.robustness(_rgb(spark, sf))
    return out.select("image_id", *[F.round(c, 5).alias(c) for c in out.columns[1:]])
