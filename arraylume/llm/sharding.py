"""K-d tree sharding by metadata, law ``bytes``: shards of near-equal size.

Documents of equal text form one group, which is never split; its point has the
metadata of the group (bytes of the text, least source and language, each as a
number in [0, 1)) and weighs the group's bytes. A node that is to give m shards is
split along its widest dimension at the weighted quantile floor(m/2)/m, found in
two distributed passes: sums of bytes in bins of the dimension, then in bins of a
hash of the text within the bin that holds the quantile (points of one bin count
as tied there and the hash decides). Only sums per node and bin reach the driver.

Edge cases: a null text has no bytes and is a group of its own; null source and
language count as empty; a table of fewer groups than shards leaves some empty; an
empty table gives no rows; repeated rows belong to one group; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arraylume.llm import common

SHARDS = 40
OVERHEAD = 16
BINS = 2048
ROWS_PER_SLOT_BUCKET = 50_000


def _unit(column):
    """A string column as a number in [0, 1)."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "utf-8")) / F.lit(float(1 << 32))


def features(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.col("text"), "utf-8")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.encode(F.lit(""), "utf-8"))).alias("text_crc32"),
        F.xxhash64("text").alias("h1"),
        F.hash("text", F.lit(7)).alias("h2"),
        _unit(F.col("source")).alias("source"),
        _unit(F.col("lang")).alias("lang"),
    )


class _Node:
    """Half-open range of shards [first, last) and the path that leads there."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _lookup(shards: int, values: dict, kind: str):
    """The node's value of a small table on the driver; null where it has none."""
    return F.element_at(F.array(*[F.lit(values.get(n)).cast(kind) for n in range(shards)]), F.col("node") + 1)


def _quantile(sums, want: float) -> tuple[int, float]:
    """First bin at which the running sum reaches ``want``, and the sum before it."""
    before = 0.0
    for b, total in sums:
        if before + total >= want:
            return b, before
        before += total
    return sums[-1][0] + 1, before


def assign(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Points (dims, ``u`` hash in [0, 1), ``weight``) with the column ``node``: their shard.

    The tree has at most ``shards`` nodes on a level; what reaches the driver is at
    most BINS sums for each of them."""
    top = points.agg(*[F.min(d).alias(f"{d}_0") for d in dims], *[F.max(d).alias(f"{d}_1") for d in dims]).first()
    scale = {d: max((top[f"{d}_1"] or 0) - (top[f"{d}_0"] or 0), 1e-12) for d in dims}
    at = points.withColumn("node", F.lit(0))
    level = [_Node(0, shards)]
    while any(n.last - n.first > 1 for n in level):
        open_ = {n.first: n for n in level if n.last - n.first > 1}
        live = at.where(F.col("node").isin(list(open_)))
        box = {r["node"]: r for r in live.groupBy("node").agg(F.sum("weight").alias("w"), *[F.min(d).alias(f"{d}_0") for d in dims], *[F.max(d).alias(f"{d}_1") for d in dims]).collect()}
        if not box:
            break
        widest = {n: max(dims, key=lambda d: (r[f"{d}_1"] - r[f"{d}_0"]) / scale[d]) for n, r in box.items()}
        look = lambda values, kind="int": _lookup(shards, values, kind)
        low = look({n: r[f"{widest[n]}_0"] for n, r in box.items()}, "double")
        step = look({n: BINS / max(r[f"{widest[n]}_1"] - r[f"{widest[n]}_0"], 1e-12) for n, r in box.items()}, "double")
        value = F.element_at(F.array(*[F.col(d).cast("double") for d in dims]), look({n: dims.index(d) + 1 for n, d in widest.items()}))
        binned = at.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((value - low) * step)).cast("int")).withColumn("sub", F.floor(F.col("u") * BINS).cast("int"))
        sums: dict = {}
        for r in binned.where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect():
            sums.setdefault(r["node"], []).append((r["bin"], float(r["w"])))
        middle, at_bin, want = {}, {}, {}
        for n in box:
            half = (open_[n].last - n) // 2
            goal = box[n]["w"] * half / (open_[n].last - n)
            middle[n] = n + half
            at_bin[n], before = _quantile(sorted(sums[n]), goal)
            want[n] = goal - before
        ties: dict = {}
        for r in binned.where(F.col("bin") == look(at_bin)).groupBy("node", "sub").agg(F.sum("weight").alias("w")).collect():
            ties.setdefault(r["node"], []).append((r["sub"], float(r["w"])))
        at_sub = {}
        for n in box:
            found = sorted(ties.get(n, [(0, 0.0)]))
            sub, before = _quantile(found, want[n])
            inside = dict(found).get(sub, 0.0)
            at_sub[n] = int(sub + (inside > 0 and want[n] - before > before + inside - want[n]))
        right = (F.col("bin") > look(at_bin)) | ((F.col("bin") == look(at_bin)) & (F.col("sub") >= look(at_sub)))
        at = common.stage(binned.withColumn("node", F.when(right, look(middle)).otherwise(F.col("node"))).drop("bin", "sub"))
        level = [m for n in level if n.last - n.first == 1 or n.first in box for m in ([n] if n.last - n.first == 1 else [_Node(n.first, middle[n.first]), _Node(middle[n.first], n.last)])]
    return at


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    rows = common.stage(features(docs))
    groups = rows.groupBy("h1", "h2", "text_crc32").agg(F.sum("size").alias("weight"), F.min("size").alias("bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    points = common.stage(groups.withColumn("length", F.log("bytes")).withColumn("u", F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / float(1 << 30)))
    homes = assign(points, ["length", "source", "lang"], shards).select("h1", "h2", "text_crc32", F.col("node").alias("shard"))
    placed = common.stage(rows.select("doc_id", "size", "text_crc32", "h1", "h2").join(homes, ["h1", "h2", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard"))
    buckets = -(-placed.count() // (shards * ROWS_PER_SLOT_BUCKET)) or 1
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = placed.groupBy("shard", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1)
    return inside.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read(spark, sf_dir, "documents"))
