"""Benchmark decontamination with a generalised suffix automaton.

Words are the maximal runs of ASCII letters and digits and of all code points
beyond ASCII, A-Z lower-cased. The benchmark items go into one automaton over
word ids; documents are streamed through it and the longest match ending at each
word tells which words lie in a shared window.

Edge cases: a null or empty text (or one without words) has no words, no hits and
is kept; items without words have no window; items of the same id count once;
items of null id are not used. Repeated rows are judged one by one. Further
columns of the documents pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common
from arraylume.llm.automaton import SuffixAutomaton

WINDOW = 13
#: A document is contaminated when SHARE * hit words >= words.
SHARE = 20
#: The automaton is broadcast; larger benchmarks have to be given in parts.
MAX_ITEM_WORDS = 2_000_000

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # after lower-casing
_WORD_SPANS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Lower-cases A-Z; ASCII that is no letter or digit becomes a blank.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes."""
    return data.translate(_FOLD).split()


@dataclass
class Index:
    """What the workers get: vocabulary, automaton and its window states."""

    vocabulary: dict[bytes, int]
    automaton: SuffixAutomaton
    window: int
    shortest: int
    #: State -> state that stands for the window of ``window`` words, or -1.
    window_state: list[int]
    #: State -> items that hold its window.
    window_items: dict[int, tuple[int, ...]]
    #: State -> (words, items) of whole short items that end there.
    short: dict[int, tuple[tuple[int, tuple[int, ...]], ...]]

    def hits(self, doc: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Mask of the hit words (None: none) and the items hit."""
        found: set[int] = set()
        if len(doc) < self.shortest:
            return None, found
        ids = np.fromiter(map(self.vocabulary.get, doc, repeat(-1)), np.int64, len(doc))
        # Words unknown to the benchmark reset the automaton, so only runs of known
        # words that can hold a window are streamed.
        out = np.flatnonzero(ids < 0)
        starts = np.concatenate(([0], out + 1))
        sizes = np.concatenate((out, [len(doc)])) - starts
        mask = None
        for run in np.flatnonzero(sizes >= self.shortest):
            begin = int(starts[run])
            for at, (state, size) in enumerate(self.automaton.matches(ids[begin : begin + int(sizes[run])].tolist()), begin + 1):
                if size < self.shortest:
                    continue
                longest = 0
                if size >= self.window and (up := self.window_state[state]) >= 0:
                    longest = self.window
                    found.update(self.window_items[up])
                for n, items in self.short.get(state, ()):
                    if n <= size:
                        longest = max(longest, n)
                        found.update(items)
                if longest:
                    if mask is None:
                        mask = np.zeros(len(doc), bool)
                    mask[at - longest : at] = True
        return mask, found


def build_index(items: list[tuple[int, bytes]], window: int = WINDOW) -> Index:
    vocabulary: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    sequences = []
    for item, data in items:
        tokens = [vocabulary.setdefault(w, len(vocabulary)) for w in words(data)]
        if tokens:
            automaton.add(item, tokens)
            sequences.append((item, tokens))
    owners = automaton.owners()
    length, link = automaton.length, automaton.link
    window_state = [-1] * len(length)
    short: dict[int, dict[int, set[int]]] = {}
    for item, tokens in sequences:
        if len(tokens) < window:
            short.setdefault(automaton.state_of(tokens), {}).setdefault(len(tokens), set()).add(item)
    chains = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__):
        if length[state] >= window:
            window_state[state] = state if length[link[state]] < window else window_state[link[state]]
        own = tuple((n, tuple(sorted(x))) for n, x in short.get(state, {}).items())
        if chain := own + chains.get(link[state], ()):
            chains[state] = chain
    used = {x for x in window_state if x >= 0}
    automaton.sequences = []
    shortest = min((min(len(t), window) for _, t in sequences), default=1 << 60)
    return Index(vocabulary, automaton, window, shortest, window_state, {x: tuple(sorted(owners[x])) for x in used}, chains)


def benchmark_index(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS):
    """Broadcast index of a benchmark table (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > 12 * max_words:
        raise ValueError(f"the benchmark has {total} characters; give it in parts of at most {12 * max_words}")
    return common.prepare(spark).sparkContext.broadcast(build_index([(r[0], r[1].encode()) for r in items.toLocalIterator()], window))


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, index, key: str = "doc_id", share: int = SHARE) -> DataFrame:
    """One row per document: key, words, hit words, items hit and the verdict."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        common.begin("decontamination")
        matcher = index.value
        for batch in batches:
            n_words, n_hit, n_items, digest = [], [], [], []
            for data in common.utf8(batch.column(1)):
                doc = words(data)
                mask, found = matcher.hits(doc)
                n_words.append(len(doc))
                n_hit.append(0 if mask is None else int(mask.sum()))
                n_items.append(len(found))
                digest.append(hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
            bad = [h > 0 and share * h >= n for h, n in zip(n_hit, n_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], names=[key, *[x.split()[0] for x in REPORT.split(", ")]])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {REPORT}")


def cut(text: str, mask: np.ndarray) -> str:
    """The text without the stretches from the first to the last word of each run of hit words."""
    spans = [m.span() for m in _WORD_SPANS.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    kept, at = [], 0
    for first, end in zip(edges[::2], edges[1::2]):
        kept.append(text[at : spans[first][0]])
        at = spans[end - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, index, share: int = SHARE, drop: bool = True) -> DataFrame:
    """The documents, all columns kept, without the spans that occur in the
    benchmark; with ``drop``, contaminated documents (by the share of hit words) go.
    ``n_chars``, where it is a column, follows the new text of a document that was cut."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        common.begin("decontamination")
        matcher = index.value
        for batch in batches:
            keep, changed = [], {}
            for row, data in enumerate(common.utf8(batch.column(at))):
                doc = words(data)
                mask, _ = matcher.hits(doc)
                bad = mask is not None and share * int(mask.sum()) >= len(doc)
                keep.append(not (drop and bad))
                if mask is not None and keep[-1]:
                    changed[row] = cut(data.decode(), mask)
            if changed:
                columns = list(batch.columns)
                values = columns[at].to_pylist()
                for row, text in changed.items():
                    values[row] = text
                columns[at] = pa.array(values, columns[at].type)
                if "n_chars" in schema.fieldNames():
                    i = schema.fieldNames().index("n_chars")
                    counts = columns[i].to_pylist()
                    for row, text in changed.items():
                        counts[row] = len(text)
                    columns[i] = pa.array(counts, columns[i].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = benchmark_index(spark, common.read(spark, sf_dir, "benchmark"))
    return scan(common.read(spark, sf_dir, "documents"), index)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH iw AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
 win AS (
   SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS g FROM iw, range(1, len(w) - {WINDOW - 2}) AS r(i) WHERE len(w) >= {WINDOW}
   UNION SELECT item_id, w FROM iw WHERE len(w) BETWEEN 1 AND {WINDOW - 1}),
 sizes AS (SELECT DISTINCT len(g) AS n FROM win),
 dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
 dg AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM dw, sizes, range(1, len(w) - n + 2) AS r(i) WHERE len(w) >= n),
 hit AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (g)),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(i, i + n) AS r(p) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
