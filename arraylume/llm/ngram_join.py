"""N-gram Jaccard self-join over group-count vectors in R-trees.

The shingles of a document are hashed and the hash range is cut into groups. The
counts per group are a point; for two documents the sum over the groups of the
smaller counts bounds their overlap, and only pairs whose bound reaches the
required overlap are verified on the hashed sets.

An R-tree over all documents prunes by size only: at these thresholds the bound's
slack exceeds the spread of the counts in any few dimensions, so every inner node
would be visited. The points are therefore dealt to trees by an exact rule over
the same kind of groups. Sets within the threshold differ in at most D shingles,
D fixed by a band of sizes; cut into more than D groups, they agree on whole groups
(see ``Bands.groups``). Sets of a band (and of the one below) with an equal group
share a block, and blocks lose no pair. Blocks of the same members are one.

Every block gets an R-tree of its points. Each member searches it for members of
other components; a hit whose finer bound, by the sketches, exceeds the need by more
than chance explains is emitted and taken for a link at once, so that a block emits
fewer such pairs than it has members (a spanning forest), however many of its pairs
are within the threshold. Pairs with a bound close to the need are emitted where
their components are still different in the end. The pairs are verified on the
sets. Where one that was taken for a link is refused, its blocks are searched again,
with the components known by then and without the refused pairs; after ``FORESTS``
such rounds the remaining blocks emit every pair that the bounds allow.

Blocks beyond CHUNK members are cut into chunks, each with a tree of its own. The
first round searches within chunks. Afterwards the members that aren't in the
block's main component, which is most often all that is left, visit the other
chunks as queries.

Documents of equal sets are one node from the start. Components are joined by
alternating stars.

Edge cases: a null or empty text (or one without words) has an empty set and is
linked with nothing; a text of fewer words than a shingle has one shingle, its
whole sequence; repeated rows are copies of each other; rows that repeat an id with
another text are linked each by its own text; rows without an id take part, and a
component without any id has none; an empty table gives no rows; further columns
are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common
from arraylume.llm.components import components

WIDTH, PERCENT = 3, 90
#: Groups of a point, and of the sketch of a set with more than FINE_SMALL shingles.
GROUPS, SKETCH_GROUPS = 512, 2_048
CHUNK = 2_000
LEAF, FANOUT = 24, 8
#: Rounds in which a block emits a forest only.
FORESTS = 3
#: Partners of a set that one task verifies.
PARTNERS = 500
WORDS_KEPT = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


class _Hashes(dict):
    """Word -> 64-bit hash; a worker keeps a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of UTF-8 bytes."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, _U)
    h = word_hashes(words)
    take = min(width, len(words))
    total = np.full(len(words) - take + 1, take, _U)
    for i in range(take):
        total = common.mix64(total * _ODD[0] + h[i : len(words) - take + 1 + i] * _ODD[1] + _U(i))
    return np.unique(total)


def fine(s: np.ndarray) -> np.ndarray:
    """The sorted fine groups, 2**32 in all, of a set's shingles."""
    return (s >> _U(32)).astype(np.uint32)


class Bands:
    """Bands of set sizes: sets within the threshold are at most one band apart."""

    def __init__(self, percent: int, most: int = 1 << 31) -> None:
        self.percent = percent
        lows, low = [], 1
        while low <= most:
            lows.append(low)
            low = low * 100 // percent + 1
        self.lows = np.array(lows)
        self._edges: dict[int, tuple[np.ndarray, int]] = {}

    def groups(self, band: int) -> tuple[np.ndarray, int]:
        """Edges of the band's groups and how many of them a set leaves out.

        Two sets of at most ``high`` shingles each that are within the threshold
        differ in at most D, so of D + 1 + spare groups they agree on spare + 1 or
        more. Each set may leave out its ``spare`` least groups in an order that
        depends on a group's content only: the greatest group on which both agree
        is left out by neither. Contents are compared by fine groups, which are
        equal where shingles are."""
        if band not in self._edges:
            high = int(self.lows[band + 1]) - 1
            differ = 2 * high * (100 - self.percent) // (100 + self.percent)
            spare = -(-differ // 3)
            count = differ + 1 + spare
            if len(self._edges) > 64:
                self._edges.clear()
            self._edges[band] = ((np.arange(1, count, dtype=object) << 32) // count).astype(np.uint32), spare
        return self._edges[band]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Block keys of a set given by its fine groups, of band, group and the
        group's content. Groups of few shingles, which unlike sets may share, are
        the ones left out."""
        own = int(np.searchsorted(self.lows, len(s), "right")) - 1
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(common.mix64(s.astype(_U) + _ODD[2]), dtype=_U)))
        out = []
        for band in (own, own + 1):
            edges, spare = self.groups(band)
            at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
            content = sums[at[1:]] - sums[at[:-1]]
            keys = common.mix64(content + np.arange(len(content), dtype=_U) * _ODD[0] + _U((band + 1) * int(_ODD[1]) & (1 << 64) - 1))
            out.append(keys[np.lexsort((keys, np.diff(at)))[spare:]] if spare else keys)
        return np.concatenate(out)


#: Sets of up to this many shingles are sketched by 2**14 groups.
SKETCH_SMALL = 4_096


def sketch(s: np.ndarray) -> bytes:
    """Of the fine groups of a small set the steps from one to the next of 2**14
    groups, a byte each (255: go on), of a larger set the counts of SKETCH_GROUPS
    groups; the first byte tells which. What a block gets of a set is bounded."""
    if len(s) > SKETCH_SMALL:
        return b"\x00" + np.bincount(s >> np.uint32(21), minlength=SKETCH_GROUPS).astype(np.uint32).tobytes()
    steps = np.diff((s >> np.uint32(18)).astype(np.int32), prepend=0)
    out = np.full(len(s) + int((steps // 255).sum()), 255, np.uint8)
    out[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return b"\x01" + out.tobytes()


class Sketch:
    """A sketch unpacked: its groups (None for a large set), counts and point."""

    def __init__(self, raw: bytes) -> None:
        self._counted = self._counts = self.groups = None
        if raw[0]:
            steps = np.frombuffer(raw, np.uint8, offset=1)
            self.groups = np.cumsum(steps, dtype=np.int32)[steps != 255]
            self.point = np.bincount(self.groups >> 5, minlength=GROUPS).astype(np.int32)
        else:
            self._counts = np.frombuffer(raw, np.uint32, offset=1).astype(np.int32)
            self.point = self._counts.reshape(GROUPS, -1).sum(axis=1, dtype=np.int32)

    def counts(self) -> np.ndarray:
        """Counts by SKETCH_GROUPS groups."""
        if self._counts is None:
            self._counts = np.bincount(self.groups >> 3, minlength=SKETCH_GROUPS).astype(np.int32)
        return self._counts

    def counted(self) -> np.ndarray:
        """Groups with the number of the shingle within its group, so that equal
        counts overlap by the smaller one."""
        if self._counted is None:
            again = np.zeros(len(self.groups), np.int32)
            for i in np.flatnonzero(self.groups[1:] == self.groups[:-1]) + 1:
                again[i] = again[i - 1] + 1
            self._counted = self.groups << 13 | again
        return self._counted


def sketch_bound(x: Sketch, y: Sketch) -> int:
    """Sum over the finest groups that both sketches have of the smaller counts."""
    if x.groups is None or y.groups is None:
        return int(np.minimum(x.counts(), y.counts()).sum())
    both = np.concatenate((x.counted(), y.counted()))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def needed(a, b, percent: int):
    """Least overlap of sets of a and b shingles within the threshold."""
    return -(-(a + b) * percent // (100 + percent))


class _Node:
    """Upper corner of the points below, their least total, the rows of a leaf or
    the children, and a row of the component that all points have (-1: several)."""

    __slots__ = ("children", "least", "one", "rows", "upper")

    def __init__(self, upper, least, rows, children) -> None:
        self.upper, self.least, self.rows, self.children, self.one = upper, least, rows, children, -1


class CountTree:
    """R-tree over count vectors, packed by cutting the widest dimension.

    Components may be joined while it is searched: nodes whose points have become
    one component are passed over by that component's queries."""

    def __init__(self, points: np.ndarray, totals: np.ndarray) -> None:
        self.points, self.totals = points, totals
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray) -> _Node:
        head = self.points[rows].max(axis=0), int(self.totals[rows].min())
        if len(rows) <= LEAF:
            return _Node(*head, rows, None)
        parts = [rows]
        while len(parts) < FANOUT:
            parts.sort(key=len)
            big = parts.pop()
            if len(big) <= LEAF:
                parts.append(big)
                break
            p = self.points[big]
            spread = p.max(axis=0) - p.min(axis=0)
            total = self.totals[big]
            values = total if total.max() - total.min() > spread.max() else p[:, int(spread.argmax())]
            order = np.argsort(values, kind="stable")
            parts += [big[order[: len(big) // 2]], big[order[len(big) // 2 :]]]
        return _Node(*head, None, [self._node(p) for p in parts])

    def search(self, q: np.ndarray, total: int, own: int, component: np.ndarray, percent: int) -> list[int]:
        """Rows whose component isn't ``own`` and whose overlap bound with the point
        q of this total reaches the need."""
        found: list[int] = []

        def visit(node: _Node) -> None:
            if node.one >= 0 and component[node.one] == own or np.minimum(q, node.upper).sum() < needed(total, node.least, percent):
                return
            if node.children is not None:
                for child in node.children:
                    visit(child)
                ones = [c.one for c in node.children]
                if min(ones) >= 0 and len(set(component[ones].tolist())) == 1:
                    node.one = ones[0]
                return
            other = node.rows[component[node.rows] != own]
            if not len(other):
                node.one = int(node.rows[0])
                return
            ok = np.minimum(self.points[other], q).sum(axis=1) >= needed(total, self.totals[other], percent)
            found.extend(other[ok].tolist())

        visit(self.root)
        return found


def margin(a: int, b: int, percent: int, groups: int) -> int:
    """What chance may add to a bound over so many groups, for sets of a and b
    shingles that just miss the need: their other shingles' shared groups."""
    need = needed(a, b, percent)
    chance = max(a - need, 0) * max(b - need, 0) / groups
    return int(chance + 4 * chance**0.5 + 2)


def block_pairs(side: list[int], component: list[int], raw: list[bytes], percent: int, refused: set, every: bool = False) -> list[tuple[int, int, bool]]:
    """Pairs of a block's rows that the bounds allow. Where the bound exceeds the
    need by the margin, the pair is sure and joined at once, so that sure pairs are a
    forest over the components; the other pairs follow, between components that are
    still different. With ``every``, all pairs of different components. Rows of side
    1 are queries only; ``refused`` holds pairs (smaller row first) that are no links."""
    sketches = [Sketch(x) for x in raw]
    points = np.array([x.point for x in sketches])
    totals, side = points.sum(axis=1), np.array(side)
    _, component = np.unique(np.array(component), return_inverse=True)
    first = np.flatnonzero(side == 0)
    if not len(first):
        return []
    tree = CountTree(points[first], totals[first])
    inside = component[first]
    out, doubtful, tried = [], [], set(refused)
    for row in range(len(raw)):
        own = sketches[row]
        for hit in first[tree.search(points[row], int(totals[row]), int(component[row]), inside, percent)].tolist():
            pair = (row, hit) if row < hit else (hit, row)
            if component[hit] == component[row] or pair in tried:
                continue
            tried.add(pair)
            sizes = int(totals[row]), int(totals[hit])
            more = sketch_bound(own, sketches[hit]) - needed(*sizes, percent)
            if more < 0:
                continue
            small = own.groups is not None and sketches[hit].groups is not None
            if every or more < margin(*sizes, percent, 1 << 14 if small else SKETCH_GROUPS):
                doubtful.append(pair)
                continue
            out.append((*pair, True))
            component[component == component[hit]] = component[row]
            inside = component[first]
    return out + [(*pair, False) for pair in doubtful if component[pair[0]] != component[pair[1]]]


def _identity(s: np.ndarray) -> tuple[bytes, int]:
    """A set's id (16 bytes) and its first 6 as a number, which finds candidates."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return digest, int.from_bytes(digest[:6], "little")


def _sets(docs: DataFrame, key: str, width: int) -> DataFrame:
    """Key, hash of the text, number of the row, id of the set and ``h`` (null for an
    empty set), size and, on the first row of a set in a partition, fine groups."""

    def run(batches):
        common.begin("ngram_join")
        seen, row = set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            sid, h, n, groups = [], [], [], []
            for data in common.utf8(batch.column(2)):
                s = shingles(data, width)
                n.append(len(s))
                own = _identity(s) if len(s) else (None, None)
                sid.append(own[0])
                h.append(own[1])
                groups.append(fine(s).tobytes() if len(s) and own[0] not in seen else None)
                seen.add(own[0])
            rows = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(sid, pa.binary()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(groups, pa.binary())], names=["id", "t", "row", "sid", "h", "n", "fine"])
        _HASHES.clear()  # idle workers shall be small
        common.end()

    read = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    return read.mapInArrow(run, "id long, t long, row long, sid binary, h long, n long, fine binary")


def _keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, h) rows of the block keys of (h, fine)."""

    def run(batches):
        common.begin("ngram_join")
        bands = Bands(percent)
        for batch in batches:
            found = [bands.keys(np.frombuffer(x, np.uint32)) for x in batch.column(1).to_pylist()]
            if found:
                keys = (np.concatenate(found) >> _U(12)).view(np.int64)  # fewer bytes to shuffle
                h = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), list(map(len, found)))
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(h[i : i + 100_000])], names=["key", "h"])
        common.end()

    return sets.select("h", "fine").mapInArrow(run, "key long, h long")


def _members(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """(key, h) of the blocks of several members."""
    # By far the largest exchange: more and smaller tasks bound an executor's memory.
    keyed = _keys(sets, percent).repartition(4 * parts, "key")
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
    # Both sides read one exchange.
    return common.stage(keyed.join(shared.hint("merge"), "key").select("key", "h").distinct())


def _blocks(members: DataFrame) -> DataFrame:
    """(key, h, c) of one block of each that have the same members, c chunks each."""
    bits = [F.bit_xor(F.xxhash64("h", F.lit(i))).alias(f"x{i}") for i in range(2)]
    several = members.groupBy("key").agg(F.count("*").alias("m"), *bits)
    chosen = several.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("c"))
    return common.stage(members.join(chosen, "key").select("key", "h", "c"))


def _sketches(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(h, node, sketch) of the nodes in ``names``. Only sketches that a filter over
    the nodes lets pass are shuffled."""
    bits, chosen = common.membership(names, "node")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(common.members(chosen.value, batch.column(2).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(np.frombuffer(x, np.uint32)) for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "sketch"])

    read = sets.where("fine IS NOT NULL").select(F.col("row").alias("node"), "fine", common.slot(F.col("row"), bits).alias("slot"))
    return read.mapInArrow(run, "node long, sketch binary").join(names, "node").select("h", "node", "sketch")


def _dealt(placed: DataFrame, first: bool) -> DataFrame:
    """Rows (key, chunk, side, node, component, sketch): the members of a chunk and,
    but in the first round, the queries that visit it from other chunks."""
    own = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("side", F.lit(0))
    if not first:
        # Sums per block and component; large blocks only.
        held = placed.where("c > 1").groupBy("key", "component").agg(F.count("*").alias("k"))
        main = held.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
        away = own.where("c > 1").join(main, "key").where("component <> main")
        visits = away.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).where("other <> chunk")
        own = own.unionByName(visits.withColumn("chunk", F.col("other")).withColumn("side", F.lit(1)).drop("other", "main"))
    return own.select("key", "chunk", "side", "node", "component", "sketch")


def _search(dealt: DataFrame, parts: int, percent: int, every: bool) -> DataFrame:
    """Pairs (key, a, b, sure), a < b, of the blocks' rows. Rows of side 2 are refused pairs
    (node, component)."""

    def run(batches):
        held: list[tuple] = []
        current = None

        def close():
            rows = sorted((r for r in held if r[0] < 2), key=lambda r: r[1])
            if len(rows) < 2:
                return []
            side, node, component, raw = zip(*rows)
            at = {x: i for i, x in enumerate(node)}
            refused = {(at[r[1]], at[r[2]]) for r in held if r[0] == 2 and r[1] in at and r[2] in at}
            return [(current[0], node[i], node[j], sure) for i, j, sure in block_pairs(side, component, raw, percent, refused, every)]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.int64()) for i in range(3)), pa.array([x[3] for x in found], pa.bool_())], names=["key", "a", "b", "sure"])

        for batch in batches:
            out = []
            for key, chunk, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, chunk) != current:
                    out += close()
                    held, current = [], (key, chunk)
                held.append(row)
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        yield batch_of(close())
        held.clear()
        common.end()

    rows = dealt.repartition(parts, "key", "chunk").sortWithinPartitions("key", "chunk")
    return rows.mapInArrow(run, "key long, a long, b long, sure boolean")


def _items(docs: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(node, items) of (node, sid, t): the hashed sets, from the texts. Texts aren't
    shuffled: a filter over their hashes picks them where they are read."""
    bits, chosen = common.membership(names, "t")

    def run(batches):
        common.begin("ngram_join")
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(common.members(chosen.value, batch.column(1).to_numpy(zero_copy_only=False))))
            sid, items = [], []
            for data in common.utf8(batch.column(0)):
                s = shingles(data, width)
                own = _identity(s)[0]
                if own not in seen:
                    seen.add(own)
                    sid.append(own)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(items, pa.binary())], names=["sid", "items"])
        _HASHES.clear()
        common.end()

    read = docs.select("text", common.slot(F.xxhash64("text"), bits).alias("slot"))
    return read.mapInArrow(run, "sid binary, items binary").join(names.select("node", "sid"), "sid").dropDuplicates(["node"]).select("node", "items")


def _linked(pairs: DataFrame, items: DataFrame, parts: int, percent: int) -> DataFrame:
    """The pairs (a, b) within the threshold. The sets of a node's partners come to it
    in lots, and the node's own set before each lot."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("lots"))
    heads = lots.join(items, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("side"), F.col("a").alias("b"), "items")
    rest = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("side"), "b").join(items.withColumnRenamed("node", "b"), "b").select("a", "lot", "side", "b", "items")

    def run(batches):
        own = None
        for batch in batches:
            a, b = [], []
            for left, side, right, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(raw, _U)
                if side == 0:
                    own = s
                    continue
                both = np.concatenate((own, s))
                both.sort()
                if int((both[1:] == both[:-1]).sum()) >= needed(len(own), len(s), percent):
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = heads.union(rest).repartition(parts, "a", "lot").sortWithinPartitions("a", "lot", "side")
    return dealt.select("a", "side", "b", "items").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that are linked with others."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = _members(sets.where("fine IS NOT NULL"), percent, parts)
    common.release(spark)
    blocks = _blocks(members)
    sketches = common.stage(_sketches(sets, common.stage(reps.join(blocks.select("h").distinct(), "h").select("node", "h"))))
    tested = spark.createDataFrame([], "a long, b long, ok boolean")
    known = spark.createDataFrame([], "node long, component long")
    refused = spark.createDataFrame([], "key long, a long, b long")
    todo = blocks

    def home(pairs: DataFrame) -> DataFrame:
        """The pairs with the components ca and cb of their nodes."""
        for c in "ab":
            of = known.select(F.col("node").alias(c), F.col("component").alias("of"))
            pairs = pairs.join(of, c, "left").withColumn(f"c{c}", F.coalesce("of", c)).drop("of")
        return pairs

    for n in range(1, FORESTS + 2):
        # Components first, on the few sketches and not on their many places.
        named = sketches.withColumn("component", F.col("node")) if n == 1 else sketches.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = todo.join(named, "h")
        dealt = _dealt(placed, n == 1)
        chunks = todo.select("key", "c").distinct()
        told = refused.join(chunks, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk"), F.lit(2).alias("side"), F.col("a").alias("node"), F.col("b").alias("component"), F.lit(None).cast("binary").alias("sketch"))
        emitted = common.stage(_search(dealt if n == 1 else dealt.unionByName(told), parts, percent, n > FORESTS))
        common.release(spark)  # the exchange of the blocks
        pairs = common.stage(emitted.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        # A node's least partner first: most of the other pairs are within a component then.
        lot = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        for part in range(2):
            if part:
                lot = home(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")).where("ca <> cb").select("a", "b")
            lot = common.stage(lot)
            if lot.isEmpty():
                break
            nodes = lot.select(F.col("a").alias("node")).union(lot.select("b")).distinct()
            items = common.stage(_items(docs, common.stage(reps.join(nodes, "node").select("node", "sid", "t")), width))
            good = _linked(lot, items, parts, percent).withColumn("ok", F.lit(True))
            tested = common.stage(tested.union(lot.join(good, ["a", "b"], "left").select("a", "b", F.coalesce("ok", F.lit(False)))))
            known = common.stage(components(tested.where("ok").select("a", "b")))
        # A refused pair matters where its block took it for a link that isn't there.
        wrong = home(emitted.where("sure").join(tested.where("NOT ok").select("a", "b"), ["a", "b"])).where("ca <> cb").select("key", "a", "b")
        refused = common.stage(refused.union(wrong))
        again = wrong.select("key").union(blocks.where("c > 1").select("key")) if n == 1 else wrong.select("key")
        todo = common.stage(blocks.join(again.distinct(), "key"))
        if todo.isEmpty():
            break
    return known


def join(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (least key reachable by links)."""
    common.prepare(docs.sparkSession)
    sets = common.stage(_sets(docs, key, width))
    reps = common.stage(sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.when(F.col("fine").isNotNull(), F.col("row"))).alias("node"), F.min("id").alias("least"), F.min("t").alias("t"), F.min("h").alias("h")))
    known = reps.join(links(docs, sets, reps, width, percent), "node").select("node", "component", "least")
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    named = reps.join(named, "node", "left").select("sid", F.coalesce("component_id", "least").alias("component_id"))
    return sets.select("id", "sid", "n").join(named, "sid", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of least key of each component, all columns kept; of rows that
    repeat that key, all stay, and so do rows without a key."""
    gone = join(docs, key, width, percent).where(F.col(key) != F.col("component_id")).select(F.col(key).cast("long").alias("gone")).distinct()
    gone = common.stage(gone)
    # Documents that the filter clears stay without a shuffle of their texts.
    chosen = common.membership(gone, "gone")
    name = common.unused(docs, "gone")
    gone = gone.withColumnRenamed("gone", name)
    side = lambda maybe: common.sift(docs, F.col(key), *chosen, maybe)
    return side(False).union(side(True).join(gone, F.col(key).cast("long") == F.col(name), "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i:i + {WIDTH - 1}] AS g FROM w, range(1, greatest(len(w) - {WIDTH - 2}, 2)) AS r(i) WHERE len(w) > 0),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pair AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 link AS MATERIALIZED (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
 both_ AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
