"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed (logs and square roots of shares),
the class means and shrinkage covariances are fitted on a bounded sample of
labelled rows, and a document's score is the logistic of the difference of the
classes' Mahalanobis log-densities, from Cholesky factors that are computed once.
Labels, language, source and id are never inputs of a score. Class priors are the
classes' shares of the fitted rows unless given.

Edge cases: a null or empty text has all counts zero and gets a score; documents
without a label are scored too; rows with a null label or id are not used to fit;
where a class has no labelled rows (or there are none at all, or no documents)
nothing tells the classes apart and every score is 0.5; repeated rows are scored each; further columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common

#: Labelled rows used to fit, at most.
MAX_FIT_ROWS = 20_000
SHRINKAGE = 0.1
HELD_OUT = 1

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@\\^~_{}[]="]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_BANG = np.zeros(256, bool)
_BANG[[ord(c) for c in "!?"]] = True
_LEAD = np.zeros(256, bool)
_LEAD[:128] = True
_LEAD[192:] = True
FEATURES = 11


def statistics(data: bytes) -> list[float]:
    """Transformed statistics of a text's UTF-8 bytes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    words = data.split()
    n, chars = max(len(words), 1), max(int(counts[_LEAD].sum()), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda k: float(np.sqrt(int(k) / chars))
    return [
        float(np.log1p(len(words))),
        float(np.log1p((chars - int(counts[_SPACE].sum())) / n)),
        share(counts[_UPPER].sum()),
        share(counts[_DIGIT].sum()),
        share(counts[_SYMBOL].sum()),
        share(counts[_STOP].sum()),
        share(counts[_BANG].sum()),
        float(np.log1p(len(lines)) - np.log1p(len(words) / 10)),
        float(np.sqrt(1 - len(set(lines)) / max(len(lines), 1))) if lines else 0.0,
        float(len(set(words)) / n**0.9),
        float(np.sqrt(sum(1 for w in words if len(w) <= 2) / n)),
    ]


@dataclass
class Discriminant:
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class: inverse of the Cholesky factor
    logs: np.ndarray  # class: log prior - log determinant / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(self.means):
            return np.full(len(x), 0.5)
        parts = []
        for mean, factor, log in zip(self.means, self.factors, self.logs):
            z = (x - mean) @ factor.T
            parts.append(log - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(parts[0] - parts[1], -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE, priors=None) -> Discriminant:
    """Covariances are shrunk towards the pooled one and its diagonal. Without rows of
    both classes the model has no means and scores 0.5."""
    groups = [x[y == k] for k in (0, 1)]
    if min(map(len, groups)) == 0:
        return Discriminant(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0))
    means = np.array([g.mean(axis=0) for g in groups])
    priors = priors or tuple(len(g) / len(x) for g in groups)
    centred = [g - m for g, m in zip(groups, means)]
    pooled = sum(c.T @ c for c in centred) / max(len(x), 1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, logs = [], []
    for c, prior in zip(centred, priors):
        cov = (1 - shrinkage) * (c.T @ c) / max(len(c), 1) + shrinkage * (0.5 * pooled + 0.5 * floor)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)))
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(prior) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(logs))


def _with(docs: DataFrame, key: str, extra: str, make) -> DataFrame:
    """Key and what ``make`` gives for a batch's features (a matrix)."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in extra.split(", "))]

    def run(batches):
        for batch in batches:
            x = np.array([statistics(d) for d in common.utf8(batch.column(1))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(x)], names=names)

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {extra}")


def remainder(key):
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % 3


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_rows: int = MAX_FIT_ROWS) -> Discriminant:
    """Fit on at most ``max_rows`` labelled rows, those of the least hash of the id,
    that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & (remainder(F.col(key)) != HELD_OUT)).groupBy(key).agg(F.max("quality").alias("y"))
    total = usable.count()
    if total > max_rows:
        usable = usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * 0.95 * max_rows / total))
    # A filter leaves the texts that are to be fitted; only their statistics move.
    usable = usable.withColumn(key, F.col(key).cast("long"))
    bits, chosen = common.membership(usable, key)

    def run(batches):
        common.begin("quality_classifier")
        for batch in batches:
            batch = batch.filter(pa.array(common.members(chosen.value, batch.column(2).to_numpy(zero_copy_only=False))))
            data = [np.array(statistics(d)).tobytes() for d in common.utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[key, "x"])

    own = F.col(key).cast("long")
    read = docs.where(own.isNotNull()).select(own.alias(key), "text", common.slot(own, bits).alias("slot"))
    found = read.mapInArrow(run, f"`{key}` long, x binary").join(usable, key).select("x", "y").collect()
    x = np.array([np.frombuffer(r[0]) for r in found]).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in found], int))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key))
    scored = _with(docs, key, "score double", lambda x: [pa.array(model.value.score(x), pa.float64())])
    return scored.select(key, (remainder(F.col(key)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The documents, all columns kept, that score ``least`` or more."""
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        common.begin("quality_classifier")
        for batch in batches:
            x = np.array([statistics(d) for d in common.utf8(batch.column(at))]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.value.score(x) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
