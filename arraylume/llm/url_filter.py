"""URL rules in a trie over reversed host labels, then path segments.

A rule ``host/path`` fits its host and all subdomains of it when the path of the
url starts with the rule's path. Of the rules that fit, the one with the longest
host wins, then the one with the longest path; of equal rules the block entry
wins. Urls without ``://`` and null urls have an empty host and path, which no
rule fits. Urls without a rule get the default verdict. Every row of the table
gets a row; repeated rows and further columns do no harm.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylume.llm import common

#: (verdict, rule) as the production set has them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"
#: The trie is broadcast; its number of rules is bounded.
MAX_RULES = 5_000_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class UrlTrie:
    """Nodes are [children by label, path node]; path nodes are
    [children by whole segment, {last segment prefix: (rule, verdict)}]."""

    def __init__(self, rules=RULES) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
        self.root: list = [{}, None]
        for verdict, rule in rules:
            self.add(rule, verdict)

    def add(self, rule: str, verdict: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        host, slash, path = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}]
        at = node[1]
        *whole, last = (slash + path).split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, {}])
        if at[1].get(last, ("", "allow"))[1] != "block":
            at[1][last] = (rule, verdict)

    def match(self, host: str, path: str):
        """(rule, verdict) of the longest rule that fits, or None."""
        if not host:
            return None
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                best = self._path(node[1], path) or best
        return best

    @staticmethod
    def _path(at, path: str):
        best = None
        for segment in path.split("/"):
            if at[1]:
                fits = next((segment[:n] for n in range(len(segment), -1, -1) if segment[:n] in at[1]), None)
                best = best if fits is None else at[1][fits]
            at = at[0].get(segment)
            if at is None:
                break
        return best


def host_and_path(url):
    """Columns host and path of a url column."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(pages: DataFrame, trie, key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """Key, host, path, winning rule (or null) and verdict of each page."""
    host, path = host_and_path(F.col("url"))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) or (None, default) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, host.alias("host"), path.alias("path")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages")
    return apply_rules(pages, spark.sparkContext.broadcast(UrlTrie()))


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return rf"""
WITH rules(v, rule, rh, rp) AS (VALUES {rules}),
 rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
 cutup AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
 best AS (SELECT page_id, max_by(rule, length(rh) * 100000 + length(rp)) AS rule, max_by(v, length(rh) * 100000 + length(rp)) AS v
   FROM cutup JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM cutup LEFT JOIN best USING (page_id)
"""


SQL = _sql()
