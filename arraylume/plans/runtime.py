"""Execution control: options, diagnostics, cancellation and the session context."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arraylume.functions.errors import BackendUnavailableError, CompilationError, MemoryBudgetExceededError
from arraylume.plans.pipeline import BACKENDS, ArrayPipeline, PreparedMap


@dataclass(frozen=True)
class Thresholds:
    """Sizes from which a backend would be chosen. Spark plans by itself, so these
    are advice that diagnostics report."""

    simd: int = 1_024
    parallel: int = 100_000
    gpu_simple: int = 2**31 - 1
    gpu_medium: int = 2_000_000
    gpu_heavy: int = 300_000


@dataclass(frozen=True)
class Options:
    backend: str = "auto"
    allow_fallback: bool = True
    max_parallelism: int | None = None
    chunk_elements: int | None = None
    memory_budget: int | None = None
    allow_chunks: bool = True
    mode: str = "strict"
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self) -> None:
        if self.backend not in BACKENDS:
            raise ValueError(f"backend {self.backend!r} is none of {', '.join(BACKENDS)}")
        if self.mode != "strict":
            raise ValueError("only the strict mode exists")
        for name in ("max_parallelism", "chunk_elements", "memory_budget"):
            if (value := getattr(self, name)) is not None and value <= 0:
                raise ValueError(f"{name} must be positive")
        if self.chunk_elements and self.memory_budget:
            raise ValueError("chunk_elements and memory_budget exclude each other")


@dataclass
class Diagnostics:
    requested: str
    used: str
    reason: str
    elements: int
    partitions: int
    seconds: float
    plan: str


class Context:
    """A session with the operations that a device context offers elsewhere."""

    def __init__(self, spark: SparkSession, options: Options = Options()) -> None:
        self.spark, self.options = spark, options
        self.tag = f"arraylume-{uuid.uuid4().hex}"

    def upload(self, df: DataFrame, kind: str = "float") -> ArrayPipeline:
        """Keeps an array in memory or on disk and fills it now."""
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return ArrayPipeline(kept, kind)

    def arrange(self, df: DataFrame, bytes_per_element: int = 4) -> DataFrame:
        """Applies the options on parallelism and chunk size to a plan."""
        o = self.options
        if o.backend == "gpu" and not self.spark.conf.get("spark.plugins", "") and not o.allow_fallback:
            raise BackendUnavailableError("no accelerator plugin is configured in spark.plugins")
        chunk = o.chunk_elements or (o.memory_budget and o.memory_budget // bytes_per_element)
        if chunk is not None:
            n = df.count()
            if o.memory_budget and n * bytes_per_element > o.memory_budget and not o.allow_chunks:
                raise MemoryBudgetExceededError(n * bytes_per_element, o.memory_budget)
            df = df.repartition(max(1, -(-n // max(chunk, 1))))
        return df.coalesce(o.max_parallelism) if o.max_parallelism else df

    def diagnose(self, df: DataFrame, fetch: bool = True) -> tuple[list | None, Diagnostics]:
        """Runs a plan and reports on it. Without ``fetch`` all rows are made but none
        comes to the driver, and there is None instead of them."""
        seen = Observation()
        began = time.perf_counter()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
        rows = watched.collect() if fetch else watched.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        used = "spark"
        reason = "Spark chooses the physical plan" if self.options.backend == "auto" else f"{self.options.backend} asked for; Spark's executors stand for it"
        return rows, Diagnostics(self.options.backend, used, reason, seen.get["n"], df.rdd.getNumPartitions(), time.perf_counter() - began, plan)

    def prepare(self, f: Callable, kind: str = "float") -> PreparedMap:
        return PreparedMap(f, kind)

    def precompile(self, *plans: DataFrame) -> list[str]:
        """Analyses and plans; code is generated when a plan first runs."""
        try:
            return [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        except Exception as wrong:
            raise CompilationError(str(wrong)) from wrong

    def run(self, job: Callable):
        """Calls ``job`` so that ``cancel`` from another thread interrupts it."""
        self.spark.addTag(self.tag)
        try:
            return job()
        finally:
            self.spark.removeTag(self.tag)

    def submit(self, job: Callable) -> Future:
        """Starts ``job`` (such as a pipeline's ``to_array``) on a thread of its own."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.run, job)
        finally:
            pool.shutdown(wait=False)

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)

    def devices(self) -> list[str]:
        """The block managers that hold data: the driver and the executors."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        return sorted(str(x) for x in self.spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keySet()))
