"""URL filter: a trie over reversed host labels and path segments.

A rule names a host (and all below it) and the beginning of a path.  The trie
walks the labels of the host from the last to the first, then the whole path
segments; what follows the last slash of a rule's path may end inside a segment
and is compared at its node.  Of all rules that fit, the one with most host
labels wins, then the one with the longest path, then allow before block.  Urls
that no rule fits get the method's default verdict, ``allow``.

The longest host comes before the longest path, as the trie walks host labels first; a rule
with a longer path on a shorter host gives way to it.

One trie holds up to ``MAX_RULES`` rules.  Longer lists are taken in blocks: every block is
one pass whose rows carry the best rule so far, is written, and is a broadcast of its own.

Cases: a null url, or one without ``://``, has an empty host and an empty path
and fits no rule; an empty path does not start with ``/``; a very long url is cut whole;
repeated rows are judged one by one, and of rules that tie the allowing one wins, then the
first by name; an empty table gives no rows, no rules give the default; columns other than
page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Store, table

#: Fixed values of the contract: (host and path prefix, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MAX_RULES = 500_000  # rules of one broadcast, about 100 bytes each in it
DEFAULT = "allow"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOW = str.maketrans(UPPER, LOWER)


@dataclass
class Node:
    below: dict[str, "Node"] = field(default_factory=dict)
    paths: "Node | None" = None  # where the host part ends and segments begin
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # rest of a segment, rule, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, as written."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOW), slash + path


class Trie:
    def __init__(self, rules: list[tuple[str, str]]):
        self.root = Node()
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOW).split(".")):
                node = node.below.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, rest = (slash + path).split("/") if slash else [""]
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            node.ends.append((rest, rule, verdict))
            node.ends.sort(key=lambda x: (-len(x[0]), x[2], x[1]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None and (found := self._path(node.paths, segments)):
                best = found
        return best

    @staticmethod
    def _path(node: Node, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            for rest, rule, verdict in node.ends:
                if segment.startswith(rest):
                    found = (rule, verdict)
                    break
            node = node.below.get(segment)
            if node is None:
                break
        return found


def weight(rule: str, verdict: str) -> tuple:
    """Sorts rules that fit one url: the least wins."""
    host, slash, path = rule.partition("/")
    return -(host.count(".") + 1 if host else 0), -len(slash + path), verdict, rule


def _pass(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) with the better of their rule and those of ``rules``."""
    shared = rows.sparkSession.sparkContext.broadcast(list(rules))

    def step(batches):
        trie = Trie(shared.value)
        for pdf in batches:
            best = []
            for host, path, *had in pdf[["host", "path", "rule", "verdict"]].itertuples(index=False):
                found = trie.match(host, path)
                if isinstance(had[0], str) and (found is None or weight(*had) <= weight(*found)):
                    found = tuple(had)
                best.append(found or (None, None))
            yield pdf.assign(rule=[x[0] for x in best], verdict=[x[1] for x in best]).astype({"page_id": "Int64"})

    return rows.mapInPandas(step, SCHEMA)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT, most: int = MAX_RULES) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url)."""

    def split(batches):
        for pdf in batches:
            cut = [split_url(url) for url in pdf.url]
            yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "host": [x[0] for x in cut], "path": [x[1] for x in cut], "rule": None, "verdict": None})

    if len(rules) <= most:
        shared = pages.sparkSession.sparkContext.broadcast(list(rules))

        def step(batches):
            trie = Trie(shared.value)
            for pdf in batches:
                rows = []
                for page, url in zip(pdf.page_id, pdf.url):
                    host, path = split_url(url)
                    rule, verdict = trie.match(host, path) or (None, default)
                    rows.append((page, host, path, rule, verdict))
                yield pd.DataFrame(rows, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

        return pages.select("page_id", "url").mapInPandas(step, SCHEMA)
    store = Store(pages.sparkSession, "urls")
    rows = pages.select("page_id", "url").mapInPandas(split, SCHEMA)
    for at in range(0, len(rules), most):
        old, rows = rows, store.put(_pass(rows, rules[at : at + most]))
        if at:
            store.drop(old)
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.k = 1
"""
