"""Token counts by a two-tier look-up on the map side; no pre-token is shuffled.

Tier one is a broadcast table of the lengths, in tokens, of pre-tokens that are
frequent in a small sample of the documents, drawn from all of them by chance
(``sample_docs`` expected, of which texts of at most ``sample_chars`` characters
count; ``table_size`` entries). It saves work only: a
pre-token that isn't in it is encoded by the library and kept in the worker's
bounded cache (tier two). Counts always cover whole texts.

Edge cases: a null or empty text has no bytes and no tokens; strings of special
tokens in a text count as the library takes them by default (one token). Repeated
rows each get a row. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import bpe, common

OVER, SEED = 512, 17
SAMPLE_DOCS, SAMPLE_CHARS, TABLE_SIZE = 1_000, 8_192, 30_000


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, table_size: int = TABLE_SIZE) -> dict[str, int]:
    counts: Counter = Counter()
    share = min(1.0, sample_docs / max(docs.count(), 1))
    for (text,) in docs.select("text").sample(share, SEED).where(F.length("text") <= sample_chars).collect():
        if not bpe.UNKNOWN.search(text):
            counts.update(bpe.PRETOKEN.findall(text))
    names = [x for x, _ in counts.most_common(table_size) if len(x) <= bpe.CACHE_CHARS]
    return dict(zip(names, (len(e.ids) for e in bpe.tokenizer(path).encode_batch(names, add_special_tokens=False))))


def count_text(text: str, lengths: bpe.Cache, special) -> int:
    total = 0
    for is_special, piece in bpe.splits(text, special):
        if is_special:
            total += 1
        elif bpe.UNKNOWN.search(piece):
            total += lengths.encode(piece)
        else:
            total += sum(map(lengths.__getitem__, bpe.PRETOKEN.findall(piece)))
    return total


def count_tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", over: int = OVER) -> DataFrame:
    """Key, UTF-8 bytes, tokens and whether there are more than ``over`` tokens."""
    common.prepare(docs.sparkSession)
    path = bpe.checked(path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        common.begin("bpe")
        lengths = bpe.cache(path, "length", len, table.value)
        special, _ = bpe.specials(path)
        for batch in batches:
            found = common.texts(batch.column(1))
            n_bytes = [len(x.encode()) for x in found]
            n = [count_text(x, lengths, special) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))
