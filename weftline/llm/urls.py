"""URL filter: a trie over reversed host labels and path segments; the longest matching entry decides.

A rule (action, host, path) fits its host and all subdomains where the URL's path starts with the rule's path.
More host labels win over fewer, then the longer path; an allow and a block of the same place: block.
The trie goes to the tasks in the closure while the rules stay under MAX_TRIE_BYTES; beyond that the rules
are joined instead (each URL's host suffixes against the rules' hosts), with the same answers.

Defined cases: a null URL, or one without "://", has an empty host and path, which no rule fits; repeated rows
are judged each; an empty table gives an empty table; other columns are left out of the result but page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Rule text up to this size travels with the tasks.
MAX_TRIE_BYTES = 8_000_000

#: The rules of op7.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or end; A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, then the path's whole segments; a last, perhaps partial
    segment is kept with the node under PARTIAL as (prefix, action, rule)."""
    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("path", segment), {})
        entries = node.setdefault("partial", {})
        if entries.get(last, ("",))[0] != "block":
            entries[last] = (action, host + path)
    return root


def walk_path(node: dict, path: str) -> tuple[str, str] | None:
    """The entry with the longest path below a host's node that the path starts with."""
    best = None
    segments = path.split("/")
    for i, segment in enumerate(segments):
        rest = "/".join(segments[i:])
        fits = [(len(p), e) for p, e in node.get("partial", {}).items() if (segment.startswith(p) if "/" not in p else rest.startswith(p))]
        if fits:
            best = max(fits)[1]
        node = node.get(("path", segment)) if i < len(segments) - 1 else None
        if node is None:
            break
    return best


def judge(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        best = walk_path(node, path) or best
    return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict). rules: a list, or a DataFrame (action, host, path) of any size."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()[0]
        if size > MAX_TRIE_BYTES:
            return filter_by_join(parsed, rules, default)
        rules = [tuple(r) for r in rules.select("action", "host", "path").collect()]

    def build():
        trie = build_trie(rules)

        def row(page_id, host, path):
            action, rule = judge(trie, host, path) or (default, None)
            return page_id, host, path, rule, action

        return row

    return map_rows(parsed, ["page_id", "host", "path"], "page_id long, host string, path string, rule string, verdict string", build)


def filter_by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules that are too many for a task: host suffixes of the distinct places meet the rules' hosts."""
    places = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = places.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    r = rules.select("action", F.col("host").alias("suffix"), F.col("path").alias("rule_path"))
    fits = suffixes.join(r, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("action", F.concat("suffix", "rule_path").alias("rule")), rank).alias("b"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))


def op7(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, r.h || r.p AS rule, action, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h) DESC, length(r.p) DESC) AS k
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON m.k = 1 AND m.page_id IS NOT DISTINCT FROM p.page_id AND m.host = p.host AND m.path = p.path
"""
