"""Rules on whole texts, and verdicts on hosts with an empirical beta prior.

Per document the base counts are taken from the text in one projection. Failures
are summed by host (here the column ``source``; null is a host of its own), the
hosts' failure rates give a beta prior by the method of moments, and a host whose
shrunk rate exceeds ``max_rate`` takes all its documents with it. Verdicts come
back by a join on the host that Spark may broadcast by its measured size and else
splits where one host is hot. Built-in functions only.

Edge cases: a null or empty text has no words and fails; repeated rows count each;
an empty table gives no rows; a single host has no prior beyond a weak one around
its own rate; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host goes when more than half of its documents are expected to fail.
MAX_RATE = 0.5
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

_SYMBOLS = "[#*$%&|<>]"


def _repeated(keys):
    """Words in windows whose key occurs twice or more: the windows' positions, in
    order, each add the words up to the next one, five at most."""

    def covered(tagged):
        near = lambda j: F.try_element_at(tagged, j)["k"]
        at = F.filter(F.transform(tagged, lambda t, j: F.when((near(j + 2) == t["k"]) | ((j > 0) & (near(F.greatest(j, F.lit(1))) == t["k"])), t["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(at), start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))["n"]

    tagged = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(common.let(tagged, covered))


def _keys(w):
    """A hash of each window of words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - WINDOW + 1, F.lit(1)))
    return F.when(F.size(w) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counts = common.let(
        common.words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            common.let(_keys(w), _repeated).cast("long").alias("n_repeat_words"),
        ),
    )
    step = docs.select(
        key,
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        counts.alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    step = step.select(key, "host", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the prior from the hosts' counts ``n`` and ``failed``."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * rate * rate).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = min(max(row["f"] / row["n"], 1e-4), 1 - 1e-4)
    spread = max(row["q"] / row["n"] - (row["f"] / row["n"]) ** 2, 0.0)
    # Of the spread of observed rates, binomial noise explains mean (1 - mean) k / n.
    between = spread - mean * (1 - mean) * row["k"] / row["n"]
    strength = mean * (1 - mean) / between - 1 if between > 0 else MOST_STRENGTH
    strength = min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    rows = common.stage(base_counts(docs, key, host))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    out = rows.join(verdicts, "host")
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS g FROM w, range(1, len(w) - {WINDOW - 2}) AS r(i) WHERE len(w) >= {WINDOW}),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, range(i, i + {WINDOW}) AS r(p) GROUP BY doc_id),
 b AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   (length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
 f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
 h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS failed FROM f GROUP BY host),
 s AS (SELECT count(*) AS k, sum(n) AS n, sum(failed) AS f, sum(n * (failed / n) * (failed / n)) AS q FROM h),
 m AS (SELECT least(greatest(f / n, 1e-4), 1 - 1e-4) AS mean, greatest(q / n - (f / n) * (f / n), 0) - least(greatest(f / n, 1e-4), 1 - 1e-4) * (1 - least(greatest(f / n, 1e-4), 1 - 1e-4)) * k / n AS between_ FROM s),
 p AS (SELECT mean, least(greatest(CASE WHEN between_ > 0 THEN mean * (1 - mean) / between_ - 1 ELSE {MOST_STRENGTH} END, {LEAST_STRENGTH}), {MOST_STRENGTH}) AS strength FROM m),
 v AS (SELECT host, (failed + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {MAX_RATE} AS kept FROM f JOIN v USING (host)
"""
