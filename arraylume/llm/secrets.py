"""Secret scans: fixed patterns and a likelihood ratio of two character Markov models.

Patterns find assignments, access keys and long hex runs. A further kind,
``markov``, takes candidate tokens of key characters, at least ``MIN_TOKEN`` long,
and keeps those whose transitions are likelier, by a mean log-likelihood ratio of
at least ``threshold`` nats a character, under the model of random strings than
under the model of ordinary identifiers and rules of punctuation. Both models are
trained from labelled samples with add-half smoothing. Built-in functions only:
positions come from the pieces between matches and the matches themselves.

Edge cases: a null or empty text has no spans; equal rows are scanned one by one;
candidates that overlap a pattern's span are left to the pattern; further columns
are ignored by ``scan`` and kept by ``redact``, which leaves null texts null.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common

#: (kind, pattern, least length of a group, group, its least length)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ASSIGN_VALUE = 6
#: Runs are maximal, so a least count is the same as dropping shorter matches.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
KINDS = ("assign", "access", "hex", "markov")
THRESHOLD = 0.35

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
WIDTH = len(ALPHABET)
#: The marks of the alphabet and how often each rule of two is in the labelled sample.
MARKS = "+/_=-"
RULE_COPIES = 4

#: Words of ordinary identifiers, from which the default labelled sample is made.
NOUNS = ("account address array average block buffer cache channel client color column config content context count counter cursor data date default delta device document domain "
         "element encoding entry error event example field file filter format frame function group handler header height history image index input instance interface item job key "
         "label language length level library limit list manager message method model module name network node number object offset option order output owner page parameter parent path "
         "pattern pixel point position process product profile property protocol query range record reference region request resource response result route row sample schema "
         "score section segment sequence server service session setting shape signal size source stage start state status step stream string style summary system table target task "
         "template text thread time title total type update user value variable vector version view weight width window worker").split()


def default_sample(n: int = 4000, seed: int = 17) -> list[tuple[str, int]]:
    """Labelled strings: 1 random (hex, base 32, base 62, base 64), 0 ordinary
    identifiers (snake, camel and kebab case, paths, with and without numbers) and
    rules of one or two punctuation marks, whose transitions no identifier shows."""
    rng = random.Random(seed)
    kinds = (string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
    out = [("".join(rng.choice(kinds[i % 4]) for _ in range(rng.randint(20, 48))), 1) for i in range(n)]
    for i in range(n):
        words = [rng.choice(NOUNS) for _ in range(rng.randint(3, 6))]
        words[rng.randrange(len(words))] += str(rng.choice((1, 2, 3, 10, 16, 32, 64, 100, 2020, 2024))) * (i % 2)
        form = i % 5
        text = "_".join(words) if form == 0 else "-".join(words) if form == 1 else "/".join(words) if form == 2 else "".join(w.capitalize() for w in words) if form == 3 else "_".join(words).upper()
        out.append((text, 0))
    out += [((a + b) * 20, 0) for a in MARKS for b in MARKS for _ in range(RULE_COPIES)]
    return out


def train(sample: list[tuple[str, int]]) -> list[float]:
    """Log-ratio random : ordinary of each transition, row by row of the alphabet."""
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[0.5] * (WIDTH * WIDTH) for _ in range(2)]
    for text, label in sample:
        codes = [at[c] for c in text if c in at]
        for a, b in zip(codes, codes[1:]):
            counts[label][a * WIDTH + b] += 1
    out = []
    for a in range(WIDTH):
        rows = [c[a * WIDTH : (a + 1) * WIDTH] for c in counts]
        sums = [sum(r) for r in rows]
        out += [round(math.log(rows[1][b] / sums[1]) - math.log(rows[0][b] / sums[0]), 6) for b in range(WIDTH)]
    return out


#: Matches that one walk over a text's matches appends to; longer lists are walked in parts.
PART = 256

# Expressions are SQL text: a Column of as many calls takes seconds to build.
_TEXT = "coalesce(text, '')"
_NONE = "cast(array() AS array<struct<start:int,`end`:int,m:string>>)"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """The body with the name bound to the value, evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _walk(part: str, at: str) -> str:
    """The matches of a part (gap before, match) that begins at a position."""
    start, end = "acc.at + x.gap", "acc.at + x.gap + length(x.m)"
    return f"aggregate({part}, struct({at} AS at, {_NONE} AS out), (acc, x) -> struct({end} AS at, concat(acc.out, array(struct({start} AS start, {end} AS `end`, x.m AS m))) AS out), acc -> acc.out)"


def _found(pattern: str) -> str:
    """Matches of a pattern in the text as structs (start, end, m) in code points."""
    quoted = _quoted(pattern)
    rows = _let(f"regexp_extract_all({_TEXT}, {quoted}, 0)", "m", f"transform(slice(split({_TEXT}, {quoted}, -1), 1, size(m)), (g, i) -> struct(length(g) AS gap, m[i] AS m))")
    cut = f"transform(sequence(0, cast(floor((size(r) - 1) / {PART}) AS int)), i -> slice(r, i * {PART} + 1, {PART}))"
    sizes = "transform(c, q -> aggregate(q, 0, (acc, x) -> acc + x.gap + length(x.m)))"
    begins = f"aggregate({sizes}, array(0), (acc, n) -> concat(acc, array(element_at(acc, -1) + n)))"
    joined = f"flatten(zip_with(c, slice({begins}, 1, size(c)), (q, at) -> {_walk('q', 'at')}))"
    return _let(rows, "r", f"CASE WHEN size(r) <= {PART} THEN {_walk('r', '0')} ELSE {_let(cut, 'c', joined)} END")


def _llr(token: str, table: list[float]) -> str:
    """Mean log-likelihood ratio a transition; the table becomes one literal."""
    ratio = f"element_at(cast(split('{','.join(map(str, table))}', ',') AS array<double>), element_at(c, i) * {WIDTH} + element_at(c, i + 1) + 1)"
    codes = f"filter(transform(split({token}, ''), k -> instr('{ALPHABET}', k) - 1), k -> k >= 0)"
    total = f"aggregate(sequence(1, size(c) - 1), 0D, (acc, i) -> acc + {ratio})"
    return f"{_let(codes, 'c', total)} / (length({token}) - 1)"


def find_spans(docs: DataFrame, sample: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, arrays of (start, kind rank, end, kind),
    sorted, and the names of these: the patterns' spans, and all spans."""
    common.prepare(docs.sparkSession)
    table = train(sample or default_sample())
    own = {k: common.unused(docs, f"found_{k}") for k in (*KINDS[:3], "token", "base", "spans")}
    keyword = " OR ".join(f"contains(lower({_TEXT}), '{w}')" for w in ("passw", "secret", "token", "apikey", "api_key"))
    when = lambda test, value: F.expr(f"CASE WHEN {test} THEN {value} ELSE {_NONE} END")
    span = lambda kind, found: f"transform({found}, x -> struct(x.start AS start, {KINDS.index(kind)} AS rank, x.`end` AS `end`, '{kind}' AS kind))"
    alone = f"filter({own['token']}, x -> NOT exists({own['base']}, b -> b.start < x.`end` AND x.start < b.`end`))"
    markov = f"CASE WHEN size({own['token']}) > 0 THEN filter({own['token']}, x -> {_llr('x.m', table)} >= {threshold}D) ELSE {_NONE} END"
    step = docs.withColumns({
        own["assign"]: when(keyword, f"filter({_found(ASSIGN)}, x -> length(regexp_extract(x.m, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_VALUE})"),
        own["access"]: when(f"contains({_TEXT}, 'AKIA')", _found(ACCESS)),
        own["hex"]: when(f"{_TEXT} RLIKE {_quoted(HEX)}", _found(HEX)),
        own["token"]: when(f"{_TEXT} RLIKE {_quoted(TOKEN)}", _found(TOKEN)),
    })
    step = step.withColumn(own["base"], F.expr(f"sort_array(concat({', '.join(span(k, own[k]) for k in KINDS[:3])}))"))
    step = step.withColumn(own["token"], F.expr(alone))
    step = step.withColumn(own["spans"], F.expr(f"sort_array(concat({own['base']}, {span('markov', markov)}))"))
    return step.drop(*[own[k] for k in (*KINDS[:3], "token")]), own["base"], own["spans"]


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    found, base, spans = find_spans(docs.select(key, "text"))
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(key, *[count(k) for k in KINDS[:3]], F.sha2(_joined(F.col(base)), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one);
    ``n_chars``, where it is a column, follows the text."""
    found, _, spans = find_spans(docs)
    text = F.col("text")
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    out = found.withColumn("text", F.when(F.size(spans) > 0, walk).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
