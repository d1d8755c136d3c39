"""Forensic measurements of images: five analyzers, weighted evidence, a vector of
35 features and a score, one row an image and no shuffle.

Images are packed rows ``image_id, width, height, encoding, r, g, b``; metadata are
columns ``software, creator_tool, generator`` (null where unknown), ``has_metadata``
says whether there are any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylume.operators.image import kernels as k

# Names of generators that metadata may give.
MARKERS = ("stable diffusion", "midjourney", "dall-e", "dalle", "comfyui", "automatic1111", "invokeai", "firefly", "generative fill")
# Weights of the analyzers in the score.
WEIGHTS = {"frequency": 0.25, "noise": 0.25, "camera": 0.20, "spatial": 0.20, "metadata": 0.10}
# Names of the features, in order.
FEATURES = (
    "noise.mean", "noise.variance", "noise.stddev", "noise.skewness", "noise.kurtosis",
    "noise.correlation.x1", "noise.correlation.y1", "noise.correlation.xy1", "noise.correlation.x2", "noise.correlation.y2",
    "noise.signal.a", "noise.signal.b", "noise.signal.r_squared",
    "frequency.low", "frequency.mid", "frequency.high", "frequency.high_to_low", "frequency.peak_ratio", "frequency.peak_count", "frequency.roughness", "frequency.periodicity",
    "camera.cfa_score", "camera.cfa_confidence", "camera.rgb.rg", "camera.rgb.rb", "camera.rgb.gb", "camera.demosaicing",
    "spatial.laplacian_variance", "spatial.gradient_mean", "spatial.gradient_variance", "spatial.edge_density", "spatial.local_contrast", "spatial.entropy",
    "metadata.available", "metadata.explicit_ai",
)
OFFSETS = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2))
MODES = ("fast", "balanced", "accurate")
BLOCK = 256


@dataclass(frozen=True)
class DetectionOptions:
    threshold: float = 0.65
    mode: str = "balanced"
    metadata: bool = True
    frequency: bool = True
    noise: bool = True
    camera: bool = True
    spatial: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("a threshold lies in 0..1")
        if self.mode not in MODES:
            raise ValueError(f"a mode is one of {', '.join(MODES)}")


def _unit(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return float(min(max(x, low), high))


def moments(values) -> tuple[float, float, float, float, float]:
    v = np.asarray(values, float).ravel()
    if not v.size:
        return (0.0,) * 5
    d = v - v.mean()
    variance = float((d * d).mean())
    if variance <= 1e-30:
        return float(v.mean()), variance, variance**0.5, 0.0, 0.0
    return float(v.mean()), variance, variance**0.5, float((d**3).mean() / variance**1.5), float((d**4).mean() / variance**2 - 3)


def regression(x, y) -> tuple[float, float, float]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2:
        return 0.0, 0.0, 0.0
    dx, dy = x - x.mean(), y - y.mean()
    slope = float((dx * dy).mean() / (dx * dx).mean()) if (dx * dx).mean() > 1e-30 else 0.0
    rest, total = float(((dy - slope * dx) ** 2).sum()), float((dy * dy).sum())
    return slope, float(y.mean() - slope * x.mean()), _unit(1 - rest / total) if total > 1e-30 else 0.0


def noise_model(signal, noise, bins: int = 16) -> tuple[float, float, float]:
    """Regression of the residual's variance on the signal, by bins of the signal
    that hold two pixels or more."""
    s, n = np.asarray(signal, float).ravel(), np.asarray(noise, float).ravel()
    code = np.clip((s * bins).astype(int), 0, bins - 1)
    count = np.bincount(code, minlength=bins)
    some = count >= 2
    if some.sum() < 2:
        return 0.0, 0.0, 0.0
    mean = lambda v: np.bincount(code, v, bins)[some] / count[some]
    return regression(mean(s), np.maximum(0, mean(n * n) - mean(n) ** 2))


@dataclass
class Finding:
    """Score, confidence, evidence rows (type, score, confidence) and features."""

    score: float
    confidence: float
    evidence: list[tuple[str, float, float]]
    features: list[float]


def _size_confidence(pixels: int) -> float:
    return _unit(np.log10(max(10, pixels)) / 7, 0.25, 1)


def analyze_noise(light, options) -> Finding:
    rest = k.residual(light)
    lags = [k.spatial_correlation(rest, dx, dy) for dx, dy in OFFSETS]
    model = noise_model(light, rest)
    smooth = _unit((0.12 - float(np.abs(lags).mean())) / 0.12)
    score = 0.7 * smooth + 0.3 * _unit((0.35 - model[2]) / 0.35)
    sure = _size_confidence(light.size)
    return Finding(score, sure, [("Noise", score, sure), ("NoiseCorrelation", smooth, sure)], [*moments(rest), *lags, *model])


def analyze_frequency(light, options) -> Finding:
    h, w = light.shape
    rings, ratio, count, rough, periodic = 0, 0.0, 0, 0.0, 0.0
    if options.mode == "fast":
        energy = [float((p * p).sum()) for p in (light, k.gradient_magnitude(light), k.laplacian(light))]
    else:
        cap, rings = (1024, 64) if options.mode == "accurate" else (512, 32)
        side = [1 << min(n, cap).bit_length() - 1 for n in (w, h)]
        if min(side) < 2:
            energy, rings = [0.0] * 3, 0
        else:
            power = k.power_spectrum2d(k.spectrum_input(light, *side))
            ring, energy = k.radial_spectrum(power, rings)
            rough = float(np.abs(np.diff(ring)).mean())
            ratio, count = k.peak_metrics(power)
            periodic = _unit((ratio - 3) / 12 + count / 100)
    total = sum(energy)
    if total <= 1e-30:
        low = mid = high = over = ratio = rough = periodic = 0.0
        count = 0
    else:
        low, mid, high = (e / total for e in energy)
        over = energy[2] / max(energy[0], 1e-30)
    score = 0.45 * _unit((high - 0.08) / 0.42) + 0.35 * _unit(periodic) + 0.2 * _unit(rough * 3)
    sure = 0.45 if options.mode == "fast" else _unit(np.log2(max(4, rings)) / 6, 0.55, 1)
    return Finding(score, sure, [("Frequency", score, sure)], [low, mid, high, over, ratio, float(count), rough, periodic])


def mosaic_scores(r, g, b) -> tuple[str, float, float]:
    """Best mosaic pattern, its score, and how far it leads the second."""
    means = k.cfa_parity_residuals(r, g, b)
    scores = {}
    for name, pattern in k.BAYER.items():
        matched = sum(means[p, pattern[p]] for p in range(4))
        others = (means.sum() - matched) / 2
        scores[name] = _unit((matched - others) / max(matched + others, 1e-12) * 2 + 0.5)
    second, best = sorted(scores.values())[-2:]
    return max(scores, key=scores.get), best, _unit((best - second) * 4)


def analyze_camera(r, g, b, options) -> Finding:
    channels, across = k.rgb_correlations(r, g, b)
    same, near = float(np.abs(channels).mean()), float(np.abs(across).mean())
    full = options.mode != "fast"
    cfa = cfa_sure = demosaicing = 0.0
    if full:
        _, cfa, cfa_sure = mosaic_scores(r, g, b)
        demosaicing = _unit((near - same + 0.25) / 0.5)
    support = 0.65 * cfa + 0.35 * demosaicing if full else _unit((same - 0.8) / 0.2)
    score = _unit(0.5 - 0.45 * support)
    share = r.size / 65536
    sure = _unit((cfa_sure + min(1.0, share)) * 0.5, 0.2, 0.9) if full else _unit(share, 0.2, 0.55)
    evidence = [("CameraSensor", score, sure)] + ([("Cfa", 1 - cfa, cfa_sure), ("Demosaicing", 1 - demosaicing, sure)] if full else [])
    return Finding(score, sure, evidence, [cfa, cfa_sure, *channels, demosaicing])


def analyze_spatial(light, options) -> Finding:
    slope = k.gradient_magnitude(light)
    measured = [moments(k.laplacian(light))[1], *moments(slope)[:2], float((slope >= 0.08).mean()), float(k.local_contrast(light).mean()), float(k.local_entropy(light, 1, 16).mean())]
    score = 0.55 * _unit((0.003 - measured[0]) / 0.003) + 0.45 * _unit((3.5 - measured[5]) / 3.5)
    sure = _size_confidence(light.size)
    return Finding(score, sure, [("SpatialStatistics", score, sure)], measured)


def _uniformity(values) -> float:
    v = np.asarray(values, float)
    mean = v.mean()
    return float(1 / (1 + v.var() / max(mean * mean, 1e-20) + (np.percentile(v, 90) - np.median(v)) / max(mean, 1e-10)))


def analyze_blocks(light, options) -> Finding:
    """Uniformity over 256-pixel blocks, and gradients at three scales."""
    h, w = light.shape
    rows = []
    for y in range(0, h, BLOCK):
        for x in range(0, w, BLOCK):
            part = light[y : y + BLOCK, x : x + BLOCK]
            means = [s.mean() if s.size else 0.0 for s in k.parity_samples(part)]
            rows.append((part.var(), (k.laplacian(part) ** 2).mean(), (k.gradient_magnitude(part) ** 2).mean(), np.var(means)))
    blocks = float(np.mean([_uniformity(c) for c in zip(*rows)]))
    planes = [light]
    for _ in range(2):
        last = planes[-1]
        planes.append(k.downsample(last, max(1, last.shape[1] // 2), max(1, last.shape[0] // 2)))
    slopes = [float(k.gradient_magnitude(p).mean()) if min(p.shape) >= 2 else 0.0 for p in planes]
    scale = 1 / (1 + 20 * float(np.abs(np.diff(slopes)).sum()))
    score, sure = _unit(0.75 * blocks + 0.25 * scale), _unit(len(rows) / 16, 0.35, 0.85)
    return Finding(score, sure, [("SpatialStatistics", score, sure)], [])


def analyze_metadata(available: bool, text: str) -> Finding:
    if not available:
        return Finding(0.0, 0.0, [], [0.0, 0.0])
    named = any(m in text.lower() for m in MARKERS)
    score, sure = (1.0, 0.98) if named else (0.0, 0.25)
    return Finding(score, sure, [("Metadata", score, sure)], [1.0, float(named)])


def combine(found: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Score and confidence of (score, confidence, weight); those of no confidence
    or weight don't count."""
    used = [x for x in found if x[1] > 0 and x[2] > 0]
    weight = sum(c * w for _, c, w in used)
    if weight <= 0:
        return 0.0, 0.0
    return _unit(sum(s * c * w for s, c, w in used) / weight), _unit(weight / sum(w for *_, w in used))


def examine(r, g, b, linear: bool, available: bool, text: str, options: DetectionOptions):
    """(score, confidence, evidence, features) of one image."""
    light = k.luminance(*((p if linear else k.srgb_to_linear(p)) for p in (r, g, b)))
    parts: list[tuple[str, float, Finding | None]] = [
        ("noise", 13, analyze_noise(light, options) if options.noise else None),
        ("frequency", 8, analyze_frequency(light, options) if options.frequency else None),
        ("camera", 6, analyze_camera(r, g, b, options) if options.camera else None),
        ("spatial", 6, analyze_spatial(light, options) if options.spatial else None),
        ("blocks", 0, analyze_blocks(light, options) if options.spatial and options.mode == "accurate" else None),
        ("metadata", 2, analyze_metadata(available, text) if options.metadata else None),
    ]
    weights = WEIGHTS | {"blocks": WEIGHTS["spatial"] / 2}
    score, sure = combine([(f.score, f.confidence, weights[n]) for n, _, f in parts if f])
    evidence = [(*e, weights[n]) for n, _, f in parts if f for e in f.evidence]
    return score, sure, evidence, [v for _, size, f in parts for v in (f.features if f else [0.0] * size)]


def detect(images: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """image_id, score, confidence, is_likely_ai, evidence and features by image."""
    have = set(images.columns)
    text = F.concat_ws(" ", *[F.col(c) if c in have else F.lit(None).cast("string") for c in ("software", "creator_tool", "generator")])
    known = F.col("has_metadata") if "has_metadata" in have else F.lit("software" in have)
    kind = images.schema["image_id"].dataType.simpleString()
    evidence_type = pa.list_(pa.struct([("type", pa.string()), ("score", pa.float64()), ("confidence", pa.float64()), ("weight", pa.float64())]))

    def run(batches):
        for batch in batches:
            out = []
            _, w, h, code, *planes, named, words = (c for c in batch.columns)
            for i in range(batch.num_rows):
                shape = (h[i].as_py(), w[i].as_py())
                if min(shape) <= 0:
                    raise ValueError("width and height must be positive")
                out.append(examine(*(p[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(shape) for p in planes), code[i].as_py() == "linear", bool(named[i].as_py()), words[i].as_py() or "", options))
            evidence = [[dict(zip(("type", "score", "confidence", "weight"), e)) for e in x[2]] for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[0] >= options.threshold for x in out], pa.bool_()), pa.array(evidence, evidence_type), pa.array([x[3] for x in out], pa.list_(pa.float64()))],
                names=["image_id", "score", "confidence", "is_likely_ai", "evidence", "features"],
            )

    schema = f"image_id {kind}, score double, confidence double, is_likely_ai boolean, evidence array<struct<type:string,score:double,confidence:double,weight:double>>, features array<double>"
    return images.select("image_id", "width", "height", "encoding", "r", "g", "b", known.alias("known"), text.alias("text")).mapInArrow(run, schema)


analyze = detect


def features(images: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """Long rows image_id, place, name and value of the 35 features."""
    names = F.array(*map(F.lit, FEATURES))
    return detect(images, options).select("image_id", F.posexplode("features").alias("place", "value")).select("image_id", "place", F.element_at(names, F.col("place") + 1).alias("name"), "value")


def camera_pattern(images: DataFrame) -> DataFrame:
    """image_id, the mosaic pattern that the colour planes agree with best (null
    below a confidence of 0.08), its score and the confidence."""
    from arraylume.operators.packed import map_rows

    def run(w, h, r, g, b):
        best, score, sure = mosaic_scores(*(p.astype(float).reshape(h, w) for p in (r, g, b)))
        return best if sure >= 0.08 else None, score, sure

    return map_rows(images, run, ["width", "height", "r", "g", "b"], ["image_id"], "pattern string, score double, confidence double")


def with_model(detections: DataFrame, model: Callable[[np.ndarray], np.ndarray], into: str = "model_score") -> DataFrame:
    """Adds what a model of one's own gives for the matrix of features."""

    def run(features: pd.Series) -> pd.Series:
        return pd.Series(model(np.stack(features.to_numpy()))).astype(float)

    return detections.withColumn(into, F.pandas_udf(run, "double")("features"))


def explicit_marker(*columns: Column) -> Column:
    """Whether the metadata text names a generator; built-in functions only."""
    text = F.lower(F.concat_ws(" ", *columns))
    found = F.lit(False)
    for marker in MARKERS:
        found = found | text.contains(marker)
    return found


def combined_score(evidence: DataFrame) -> DataFrame:
    """Weighted score of rows (image_id, score, confidence, weight), as an aggregation."""
    used = (F.col("confidence") > 0) & (F.col("weight") > 0)
    w = F.when(used, F.col("weight") * F.col("confidence")).otherwise(0.0)
    total, plain = F.sum(w), F.sum(F.when(used, F.col("weight")).otherwise(0.0))
    bound = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return evidence.groupBy("image_id").agg(F.when(total > 0, bound(F.sum(w * F.col("score")) / F.when(total > 0, total))).otherwise(0.0).alias("score"), F.when(total > 0, bound(total / F.when(plain > 0, plain))).otherwise(0.0).alias("confidence"))


#: Changes that a robust score should survive, by name, on planes r, g, b.
TRANSFORMATIONS = {
    "resize-50-percent": lambda r, g, b: [k.resize(p, max(1, p.shape[1] // 2), max(1, p.shape[0] // 2)) for p in (r, g, b)],
    "gaussian-blur-1": lambda r, g, b: [k.gaussian_blur(p, 2, 1.0) for p in (r, g, b)],
    "camera-simulation": lambda r, g, b: k.simulate_camera(r, g, b, blur=0.5, shot=0.001, read=0.0005, sharpening=0.15, seed=1),
}


def robustness(images: DataFrame, options: DetectionOptions = DetectionOptions(), transformations: dict | None = None) -> DataFrame:
    """Score of the image as it is and the least, largest and mean score of it and
    its changed versions; stability is 1 - (largest - least). A JPEG round trip
    isn't among the defaults, as there is no encoder here; pass one by name."""
    from arraylume.operators.packed import map_rows

    changes = TRANSFORMATIONS if transformations is None else transformations
    if any(not n.strip() for n in changes):
        raise ValueError("a transformation needs a name")
    meta = [c for c in ("software", "creator_tool", "generator", "has_metadata") if c in images.columns]
    head = ["image_id", "encoding", *meta]
    all_ = detect(images, options).select("image_id", F.lit("").alias("name"), "score")
    for name, change in changes.items():

        def run(w, h, r, g, b, change=change):
            out = change(*(p.astype(float).reshape(h, w) for p in (r, g, b)))
            return out[0].shape[1], out[0].shape[0], *out

        changed = map_rows(images, run, ["width", "height", "r", "g", "b"], head, "width int, height int, r array<double>, g array<double>, b array<double>")
        all_ = all_.union(detect(changed, options).select("image_id", F.lit(name).alias("name"), "score"))
    top, low = F.max("score"), F.min("score")
    return all_.groupBy("image_id").agg(F.max(F.when(F.col("name") == "", F.col("score"))).alias("original"), low.alias("minimum"), top.alias("maximum"), F.avg("score").alias("mean"), F.greatest(F.lit(0.0), F.lit(1.0) - (top - low)).alias("stability"))
