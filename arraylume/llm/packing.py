"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document is its token ids and one closing id. Whole windows are cut off its
front; the rest is cut into pieces of at most ``piece`` tokens, so that a group of
pieces can be spread evenly. A task gathers pieces until they fill
``group_windows`` windows, then parts them among the least number of windows:
partial partitions (one slot a window) are merged, those of the largest spread
first, the fullest slot of one with the emptiest of the other. While the fullest
window exceeds the capacity, the number of windows rises by one.

There is no shuffle: groups never leave their task, and at most one group is in
memory. Sequence ids hold the task's partition and are unique.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed
each by itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from arraylume.llm import bpe, common

CAPACITY, PIECE, GROUP_WINDOWS, CLOSING = 2048, 512, 128, 1

OUTPUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Packers of few ids, by their number.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def ids_bytes(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def encode(text: str, known: bpe.Cache, special, ids: dict[str, int]) -> bytes:
    """Token ids of a text as little-endian unsigned 32-bit integers."""
    out = []
    for is_special, piece in bpe.splits(text, special):
        if is_special:
            out.append(ids_bytes([ids[piece]]))
        elif bpe.UNKNOWN.search(piece):
            out.append(known.encode(piece))
        else:
            out += map(known.__getitem__, bpe.PRETOKEN.findall(piece))
    return b"".join(out)


def differencing(sizes: list[int], slots: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of ``slots`` near-equal parts."""
    if slots == 1:
        return [list(range(len(sizes)))]
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    # Items start as partial partitions of one filled slot each. Merging the next
    # ``slots`` largest of them opposes nothing yet, so each such run is one partition.
    heap = []
    for n, at in enumerate(range(0, len(order), slots)):
        run = order[at : at + slots]
        sums = np.zeros(slots, np.int64)
        sums[slots - len(run) :] = [sizes[i] for i in reversed(run)]
        parts = [[] for _ in range(slots - len(run))] + [[i] for i in reversed(run)]
        heap.append((-int(sums[-1] - sums[0]), n, sums, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        merged = a + b[::-1]
        order_ = np.argsort(merged, kind="stable")
        both = [p + q for p, q in zip(x, reversed(y))]
        merged = merged[order_]
        heapq.heappush(heap, (-int(merged[-1] - merged[0]), n, merged, [both[i] for i in order_]))
    return heap[0][3]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items by window; no window holds more than the capacity."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item is larger than a window")
    slots = -(-sum(sizes) // capacity)
    while True:
        parts = differencing(sizes, slots)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return [x for x in parts if x]
        slots += 1


def pack_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: key, start and length in the document's ids, CRC-32 of
    the piece's ids, the document's ids, sequence and offset there."""
    common.prepare(docs.sparkSession)
    path = bpe.checked(path)
    kind = docs.schema[key].dataType.simpleString()

    names = [key, *(x.split()[0] for x in OUTPUT.split(", "))]

    def run(batches):
        common.begin("bpe")
        known = bpe.cache(path, "ids", ids_bytes)
        special, ids = bpe.specials(path)
        closing = ids_bytes([CLOSING])
        base = TaskContext.get().partitionId() << 40
        made = 0
        # Pieces of the group, and whole windows: key, start, length, CRC, document's ids.
        rows, whole = ([], [], [], [], []), ([], [], [], [], [])
        waiting, kind_of_key = 0, None

        def add(columns, *values):
            for column, value in zip(columns, values):
                column.append(value)

        def batch_of(columns, order, sequence, offset):
            """The rows in this order, and the columns emptied."""
            arrays = [pa.array(columns[0], kind_of_key).take(pa.array(order)), *(pa.array(np.array(c, np.int64)[order]) for c in columns[1:])]
            for column in columns:
                column.clear()
            return pa.RecordBatch.from_arrays([*arrays, pa.array(base + sequence), pa.array(offset)], names=names)

        def group():
            nonlocal made, waiting
            sizes = np.array(rows[2])
            parts = pack(rows[2], capacity)
            order = np.concatenate([np.array(x) for x in parts])
            ends = np.cumsum(sizes[order])
            counts = np.array([len(x) for x in parts])
            before = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)[:-1]))]
            out = batch_of(rows, order, made + np.repeat(np.arange(len(parts)), counts), ends - sizes[order] - np.repeat(before, counts))
            made += len(parts)
            waiting = 0
            return out

        def windows():
            nonlocal made
            n = len(whole[0])
            made += n
            return batch_of(whole, np.arange(n), made - n + np.arange(n), np.zeros(n, np.int64))

        for batch in batches:
            kind_of_key = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
                data = memoryview(encode(text, known, special, ids) + closing)
                total, start = len(data) // 4, 0
                while start < total:
                    size = capacity if total - start >= capacity else min(piece, total - start)
                    add(whole if size == capacity else rows, doc, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), total)
                    start += size
                    if size < capacity:
                        waiting += size
                        if waiting >= capacity * group_windows - piece:
                            yield group()
                if len(whole[0]) >= 5_000:
                    yield windows()
        if rows[0]:
            yield group()
        if whole[0]:
            yield windows()

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {OUTPUT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
