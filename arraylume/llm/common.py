"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Upper bound of one Arrow batch sent to a Python worker.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound the Arrow batches and make
    sure that a checkpoint directory is set. An existing setting is kept."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    # Workers give freed memory back instead of keeping it for later.
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1000000")):
        env.setdefault(name, value)
    for key, value in (("maxBytesPerBatch", BATCH_BYTES),):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    if not spark.sparkContext.getCheckpointDir():
        # The warehouse is a folder that driver and executors share, too.
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    return prepare(spark).sparkContext.getCheckpointDir()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared directory."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back the files of exchanges that nothing refers to any more. Spark does so
    when the driver collects garbage, which may be long after a large exchange was
    read for the last time; an operator calls this once after such an exchange."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of the documents has; Spark
    tells no upper from lower case in names."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What workers keep between tasks, by operator: functions that drop it.
KEPT: dict[str, object] = {}


def begin(operator: str) -> None:
    """A worker that starts on an operator drops what others keep in it, so that it
    never holds more than one operator's caches."""
    for name, drop in KEPT.items():
        if name != operator:
            drop()


def end() -> None:
    """Give memory that a task has freed back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Bits of a membership filter: 16 a value, but never more than this (16 MB to
#: broadcast). With more values than that the filter lets more rows pass, and the
#: exact join that follows it does the rest.
FILTER_BITS = 1 << 27
_PAGE = 1 << 15


def slot(column, bits: int, hashed: bool = False):
    """Place of a long column's value in a filter; of a hash, its low bits."""
    return F.pmod(column if hashed else F.xxhash64(column), F.lit(bits)).cast("long")


def membership(df: DataFrame, column: str, hashed: bool = False):
    """(bits, broadcast bit set) by ``slot`` of the values of a long column."""
    bits, total = _PAGE, df.count()
    while bits < min(16 * total, FILTER_BITS):
        bits *= 2
    at = slot(F.col(column), bits, hashed) + 1
    pages = df.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
    whole = np.zeros(bits // 8, np.uint8)
    for page, bitmap in pages:
        whole[(page - 1) * _PAGE // 8 : page * _PAGE // 8] = np.frombuffer(bitmap, np.uint8)
    return bits, prepare(df.sparkSession).sparkContext.broadcast(whole)


def members(whole: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the values in these slots."""
    return (whole[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a string column; null becomes b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, element by element."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column as an array; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def let(value, body):
    """``body(v)`` with v evaluated once a row, wherever the optimiser puts it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sift(docs: DataFrame, key, bits: int, whole, maybe: bool = True) -> DataFrame:
    """The rows whose key the filter may hold, or with ``maybe`` false the others
    (those of null key among them). Nothing is shuffled."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            slots = batch.column(batch.num_columns - 1)
            hit = members(whole.value, slots.fill_null(0).to_numpy(zero_copy_only=False)) & slots.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=batch.schema.remove(batch.num_columns - 1)).filter(pa.array(hit == maybe))

    at = F.when(key.isNotNull(), slot(key.cast("long"), bits))
    return docs.withColumn(unused(docs, "slot"), at).mapInArrow(run, schema)
