"""Substring deduplication with suffix automata of reference shards.

The reference of a document is every document of smaller id: it grows with the
corpus, so an automaton of it has no bounded size to broadcast. The reference is
therefore cut down to the passages that occur twice, each kept once, and dealt to
shards of bounded size, each with an automaton of its own:

1. Documents of equal words are one (the least id stands for them).
2. Each document gives anchors, the minimizers of its half-windows: any window of
   ``window`` words has one, and equal windows have equal ones. An anchor of two
   different contents is shared; only windows around shared anchors can repeat.
3. Those windows are hashed (96 bits) and the least document of each hash, its
   owner, is found with partial sums on the map side.
4. Owners give the reference: maximal runs of their own repeated windows with one
   minimizer, which is also the key of the shard. Documents that hold shared anchors
   give their runs in the same way, so that a window and all its copies meet in one
   shard; a filter of bounded size leaves out windows that repeat nowhere.
5. In its shard each document run is streamed through the automaton of the reference
   passages. Where the longest match reaches ``window`` words, the window belongs to
   the passage's owner, and it is covered if that owner is a smaller document. The
   words compared are the words themselves.
6. The covered spans, maximal by union, go.

Shards that get many document rows are salted: their reference is built once a salt.

Edge cases: a null or empty text has no words; a text of fewer words than a window
keeps all; repeated rows of one id are no copies of each other by id, so neither
loses a word to the other; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common
from arraylume.llm.automaton import SuffixAutomaton
from arraylume.llm.ngram_join import word_hashes

WINDOW = 50
#: Repeated windows of a shard's reference, about; document rows of a salt, about.
SHARD_WINDOWS, SALT_ROWS = 50_000, 50_000
#: One document in so many is counted to choose the salts.
SALT_SAMPLE = 32
_U = np.uint64
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.concatenate((np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U), dtype=_U))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = tuple(map(_Powers, _BASES))


def rolling(h: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, the same wherever the run stands."""
    if len(h) < size:
        return np.zeros(0, _U)
    up, down = _POWERS[base].to(len(h) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * up[: len(h)], dtype=_U)))
    return common.mix64((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Extremes of all runs of ``size`` values, by prefixes and suffixes of blocks."""
    n = len(x)
    pad = -n % size
    full = np.concatenate((x, np.full(pad, x[-1], x.dtype))).reshape(-1, size)
    left = pick.accumulate(full, axis=1).ravel()
    right = pick.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[: n - size + 1], left[size - 1 : n])


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and hashes of a document's minimizers, and their width in words."""
    width = window // 2
    grams = rolling(h, width)
    span = window - width + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, _U), width
    low = _slide(grams, span, np.minimum)
    edge = np.zeros(span - 1, _U)
    at = np.flatnonzero(_slide(np.concatenate((edge, low, edge)), span, np.maximum) == grams)
    return at, grams[at], width


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _contents(docs: DataFrame, key: str, window: int) -> DataFrame:
    """Per document: id, SHA-256 of its words, words, and its distinct anchors
    (those of equal contents once a partition)."""

    def run(batches):
        seen = set()
        for batch in batches:
            digests, n, found = [], [], []
            for data in common.utf8(batch.column(1)):
                words = data.split()
                digest = _digest(words)
                digests.append(digest)
                n.append(len(words))
                if len(words) < window or digest in seen:
                    found.append(np.zeros(0, np.int64))
                    continue
                seen.add(digest)
                found.append(np.unique(anchors(word_hashes(words), window)[1]).view(np.int64))
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            h = [int.from_bytes(x[:8], "little", signed=True) for x in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["id", "digest", "h", "n", "anchors"])

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(run, "id long, digest binary, h long, n long, anchors array<long>")


def _windows(suspects: DataFrame, window: int) -> DataFrame:
    """Windows around shared anchors of (id, text, shared): hash and check."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, data, shared in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), batch.column(2)):
                h = word_hashes(data.split())
                start = _candidates(h, _longs(shared.values), window)
                if len(start):
                    out.append((np.full(len(start), doc), rolling(h, window)[start].view(np.int64), (rolling(h, window, 1)[start] >> _U(33)).astype(np.int32)))
            if out:
                doc, w, c = map(np.concatenate, zip(*out))
                for i in range(0, len(doc), 100_000):
                    j = i + 100_000
                    yield pa.RecordBatch.from_arrays([pa.array(doc[i:j]), pa.array(w[i:j]), pa.array(c[i:j])], names=["id", "w", "c"])

    return suspects.select("id", "text", "shared").mapInArrow(run, "id long, w long, c int")


def _candidates(h: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    at, grams, width = anchors(h, window)
    at = at[np.isin(grams, shared)]
    edges = np.zeros(max(len(h), window) + 2, np.int64)
    np.add.at(edges, np.maximum(at + width - window, 0), 1)
    np.add.at(edges, np.minimum(at, len(h) - window) + 1, -1)
    return np.flatnonzero(np.cumsum(edges)[: max(len(h) - window + 1, 0)] > 0)


def _longs(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).view(_U)


def _runs(words: list[bytes], h: np.ndarray, start: np.ndarray, window: int, shards: int):
    """(shard, first start, words joined by blanks) of the maximal runs of windows
    that follow each other and have one minimizer."""
    if not len(start):
        return
    width = window // 2
    low = _slide(rolling(h, width), window - width + 1, np.minimum)[start]
    cuts = np.flatnonzero((np.diff(start) != 1) | (low[1:] != low[:-1])) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
        begin = int(start[i])
        yield int(low[i] % _U(shards)), begin, b" ".join(words[begin : int(start[j - 1]) + window])


def _rows(found) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["shard", "id", "start", "passage"])


_RUN = "shard int, id long, start int, passage binary"


def _document_runs(suspects: DataFrame, window: int, shards: int, chosen) -> DataFrame:
    """Runs of the windows of (id, text, shared) that may repeat."""
    bits, allowed = chosen

    def run(batches):
        for batch in batches:
            out = []
            for doc, data, shared in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), batch.column(2)):
                words = data.split()
                h = word_hashes(words)
                start = _candidates(h, _longs(shared.values), window)
                hashes = rolling(h, window)[start] & _U(bits - 1)
                start = start[common.members(allowed.value, hashes.astype(np.int64))]
                out += [(shard, doc, first, passage) for shard, first, passage in _runs(words, h, start, window, shards)]
                if len(out) > 5_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return suspects.select("id", "text", "shared").mapInArrow(run, _RUN)


def _reference_runs(owners: DataFrame, window: int, shards: int) -> DataFrame:
    """Runs of the windows of (id, text, own) whose hash is among the owner's."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, data, own in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), batch.column(2)):
                words = data.split()
                h = word_hashes(words)
                start = np.flatnonzero(np.isin(rolling(h, window), _longs(own.values)))
                out += [(shard, doc, first, passage) for shard, first, passage in _runs(words, h, start, window, shards)]
                if len(out) > 5_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return owners.select("id", "text", "own").mapInArrow(run, _RUN)


class ShardAutomaton:
    """Automaton of a shard's reference passages with the owner of each window."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.kept = window, {}
        self.tokens: dict[bytes, int] = {}
        self.automaton = a = SuffixAutomaton()
        for owner, passage in passages:
            a.add(owner, [self.tokens.setdefault(w, len(self.tokens)) for w in passage.split(b" ")])
        length, link = a.length, a.link
        self.state = [-1] * len(length)
        for s in sorted(range(1, len(length)), key=length.__getitem__):
            if length[s] >= window:
                self.state[s] = s if length[link[s]] < window else self.state[link[s]]
        self.owner: dict[int, int] = {}
        for owner, tokens in a.sequences:
            for s, size in a.matches(tokens):
                if size >= window:
                    at = self.state[s]
                    self.owner[at] = min(owner, self.owner.get(at, owner))
        a.sequences = []

    def windows(self, passage: bytes) -> list[tuple[int, int]]:
        """(place, owner) of the windows of a passage that the reference holds."""
        if passage not in self.kept:
            if len(self.kept) >= 2_000:
                self.kept.clear()
            tokens = [self.tokens.get(w, -1) for w in passage.split(b" ")]
            self.kept[passage] = [(end - self.window, self.owner[self.state[s]]) for end, (s, size) in enumerate(self.automaton.matches(tokens), 1) if size >= self.window]
        return self.kept[passage]


def _stream(dealt: DataFrame, window: int) -> DataFrame:
    """Covered starts of the document runs among rows (shard, salt, side, id, start,
    passage) sorted by the first three, reference (side 0) first."""

    def run(batches):
        current, passages, automaton = None, [], None
        for batch in batches:
            ids, found = [], []
            for shard, salt, side, doc, start, passage in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, salt) != current:
                    current, passages, automaton = (shard, salt), [], None
                if side == 0:
                    passages.append((doc, passage))
                    continue
                if automaton is None:
                    automaton, passages = ShardAutomaton(passages, window), []
                hit = [start + place for place, owner in automaton.windows(passage) if owner < doc]
                if hit:
                    ids.append(doc)
                    found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["id", "starts"])

    return dealt.select("shard", "salt", "side", "id", "start", "passage").mapInArrow(run, "id long, starts array<int>")


def _rest(covered: DataFrame, window: int) -> DataFrame:
    """Removed words and digest of the kept ones of (id, text, starts)."""

    def run(batches):
        for batch in batches:
            removed, digests = [], []
            for data, starts in zip(common.utf8(batch.column(1)), batch.column(2)):
                words = data.split()
                at = starts.values.to_numpy(zero_copy_only=False)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                gone = np.cumsum(edges)[:-1] > 0
                removed.append(int(gone.sum()))
                digests.append(_digest([w for w, x in zip(words, gone) if not x]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())], names=["id", "removed", "rest"])

    return covered.select("id", "text", "starts").mapInArrow(run, "id long, removed long, rest binary")


def dedup(docs: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Key, words, removed words and SHA-256 of the kept words joined by spaces."""
    spark = common.prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = common.stage(_contents(docs, key, window))
    reps = common.stage(contents.where(F.col("n") >= window).groupBy("digest").agg(F.min("id").alias("rep"), F.first("h").alias("h")))

    keyed = contents.where("size(anchors) > 0").select(F.explode("anchors").alias("anchor"), "h").repartition(parts, "anchor")
    twice = keyed.groupBy("anchor").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("anchor")
    shared = common.stage(keyed.join(twice.hint("merge"), "anchor").groupBy("h").agg(F.collect_set("anchor").alias("shared")))
    del keyed, twice
    common.release(spark)
    chosen = reps.join(shared, "h").select(F.col("rep").alias("id"), "shared")
    chosen = common.stage(chosen)
    texts = docs.select(F.col(key).cast("long").alias("id"), "text")
    suspects = common.stage(common.sift(texts, F.col("id"), *common.membership(chosen, "id")).join(chosen, "id"))

    least = common.stage(_windows(suspects, window).groupBy("w", "c").agg(F.min("id").alias("owner"), F.max("id").alias("top")).where("owner < top").select("w", "c", "owner"))
    common.release(spark)
    shards = max(parts, -(-least.count() // SHARD_WINDOWS))
    owned = least.groupBy(F.col("owner").alias("id")).agg(F.collect_set("w").alias("own"))
    reference = _reference_runs(suspects.select("id", "text").join(owned, "id"), window, shards).select("shard", F.lit(0).alias("side"), "id", "start", "passage")
    # The filter's slots are low bits of w, which is a hash itself.
    chosen = common.membership(least, "w", hashed=True)
    few = _document_runs(suspects.where(F.pmod(F.xxhash64("id"), F.lit(SALT_SAMPLE)) == 0), window, shards, chosen)
    salts = common.stage(few.groupBy("shard").agg((F.ceil(F.count("*") * SALT_SAMPLE / SALT_ROWS)).cast("int").alias("salts")))
    n = F.coalesce("salts", F.lit(1))
    reference = reference.join(salts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
    runs = _document_runs(suspects, window, shards, chosen).withColumn("side", F.lit(1)).join(salts, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("id"), n).cast("int"))
    columns = ["shard", "salt", "side", "id", "start", "passage"]
    dealt = reference.select(columns).union(runs.select(columns)).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "side")
    starts = _stream(dealt, window).groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = common.stage(_rest(suspects.join(starts, "id"), window))

    named = contents.select("id", "digest", "n").join(reps.select("digest", "rep"), "digest", "left").join(cut, "id", "left")
    copy = F.col("rep") < F.col("id")
    return named.select(
        F.col("id").alias(key),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("rest", "digest")))).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents"))


SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM w, range(1, len(w) - {WINDOW - 2}) AS r(i) WHERE len(w) >= {WINDOW}),
 o AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
 c AS (SELECT DISTINCT doc_id, p FROM g JOIN o USING (g), range(i, i + {WINDOW}) AS r(p) WHERE owner < doc_id),
 u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
