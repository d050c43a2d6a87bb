"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words; every window of
``width`` consecutive words of an item (the whole item if it has fewer, but some)
becomes one pattern.  Words of the benchmark are numbered, and patterns are strings
of these numbers as characters, so the automaton has one node for each word of a
window.  A document is normalised the same way, its words are numbered (others are a
character that no pattern has), and it is scanned once; the end of a match is the
number of its last word, which gives the place in the original text.  ``spans`` holds
these places: character ranges [start, end) of the text, of touching words as one.

Cases: null or wordless texts have no words and are clean; a null or wordless
item has no window; the windows of an item without id count, but name no item; a very
long text is scanned whole; repeated rows are judged one by one; items that repeat an id
are one name, ties of items are sorted as strings; an empty benchmark leaves every
document clean; an empty table gives no rows; other columns of the inputs are not read.
One automaton holds up to ``BLOCK_WORDS`` words of items, about 170 MB in a worker.
Larger benchmarks are taken in blocks of that size, each a bounded broadcast and one
more scan; the places found are united per document by a join that moves no text.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_RE, ALNUM_TABLE, alnum_words, encode, like_input, table

WIDTH = 13
#: Words of items in one automaton: 13 x 250,000 nodes of about 50 bytes at most.
BLOCK_WORDS = 250_000
SHARE = 20  # contaminated: hit words are at least 1 in 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def windows(text: str | None, width: int = WIDTH) -> list[tuple[bytes, ...]]:
    words = alnum_words(text)
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _letter(i: int) -> str:
    """The character of word number i, from 1; surrogates are left out."""
    return chr(i if i < 0xD800 else i + 0x800)


class Matcher:
    """The automaton over the windows of some items."""

    _made: dict[str, "Matcher"] = {}

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item, text in items:
            for w in windows(text, width):
                name = "".join([self.letters.get(x) or self.letters.setdefault(x, _letter(len(self.letters) + 1)) for x in w])
                owners.setdefault(name, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for name, ids in owners.items():
            self.automaton.add_word(name, (len(name), tuple(i for i in ids if i is not None)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, shared, width: int = WIDTH) -> "Matcher":
        """One matcher for each named broadcast and Python worker."""
        if name not in cls._made:
            cls._made.clear()
            cls._made[name] = cls(shared.value, width)
        return cls._made[name]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit ranges of words (end excluded) and items found."""
        words = encode(text).translate(ALNUM_TABLE).split()
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if words and not self.empty:
            get = self.letters.get
            for last, (n, ids) in self.automaton.iter("".join([get(w, "\0") for w in words])):
                spans.append((last + 1 - n, last + 1))
                items.update(ids)
        return len(words), spans, items

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Character ranges of the original text that windows cover, merged."""
        return places(text, merged(self.scan(text)[1]))


def places(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of ranges of words."""
    if not hits:
        return []
    at = _places(text)
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def shown(ranges: list) -> str:
    return ";".join(f"{a}-{b}" for a, b in ranges)


def _places(text: str) -> list[tuple[int, int]]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [m.span() for m in re.finditer(ALNUM_RE, lower)]


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(found: list) -> list[list[int]]:
    """Ranges of words with their places, sorted, to the places of touching ones as one."""
    out: list[list[int]] = []
    for a, b, start, end in found:
        if out and a <= out[-1][1]:
            out[-1] = [out[-1][0], max(b, out[-1][1]), out[-1][2], max(end, out[-1][3])]
        else:
            out.append([a, b, start, end])
    return [x[2:] for x in out]


def verdict(n_words: int, spans, items) -> tuple[int, int, str, bool]:
    hit = sum(b - a for a, b in merged(spans))
    names = sorted(str(int(i)) for i in items)
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and SHARE * hit >= n_words


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """Lists of (item_id, text) with a bounded number of words each."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        n = len(alnum_words(row.text))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


def _scanner(shared, width):
    name = uuid.uuid4().hex

    def step(batches):
        m = Matcher.of(name, shared, width)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                n, spans, items = m.scan(text)
                rows.append((doc, n, *verdict(n, spans, items), shown(places(text, merged(spans)))))
            yield pd.DataFrame(rows, columns=FIELDS).astype({"doc_id": "Int64"})

    return step


def _finder(shared, width):
    name = uuid.uuid4().hex

    def step(batches):
        m = Matcher.of(name, shared, width)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                n, spans, items = m.scan(text)
                if spans:
                    spans = merged(spans)
                    rows.append((doc, hashlib.sha256(encode(text)).hexdigest(), [[*x, *y] for x, y in zip(spans, places(text, spans))], sorted(map(int, items))))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "spans", "items"]).astype({"doc_id": "Int64"})

    return step


def decontamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A verdict for every row of ``docs`` (doc_id, text) against all items."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    found = None
    parts = blocks(benchmark, block_words)
    block, after = next(parts), next(parts, None)
    if after is None:
        return docs.mapInPandas(_scanner(spark.sparkContext.broadcast(block), width), SCHEMA)
    while block is not None:
        part = docs.mapInPandas(_finder(spark.sparkContext.broadcast(block), width), "doc_id long, key string, spans array<array<int>>, items array<long>")
        found = part if found is None else found.unionByName(part)
        block, after = after, next(parts, None)
    united = found.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    keyed = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.size(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("(" + ALNUM_RE + ")"))).alias("n_words"))
    joined = keyed.join(united, keyed.doc_id.eqNullSafe(united.d) & (keyed.key == united.k), "left").select("doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), "spans", "items")

    def finish(batches):
        for pdf in batches:
            rows = []
            for doc, n, found, items in zip(pdf.doc_id, pdf.n_words, pdf.spans, pdf["items"]):
                found = [] if found is None else sorted(tuple(x) for x in found)
                rows.append((doc, n, *verdict(n, [x[:2] for x in found], [] if items is None else items), shown(_joined(found))))
            yield pd.DataFrame(rows, columns=FIELDS).astype({"doc_id": "Int64"})

    return joined.mapInPandas(finish, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    spark = docs.sparkSession
    parts = blocks(benchmark, block_words)
    block, after = next(parts), next(parts, None)
    if after is None:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def step(batches):
            m = Matcher.of(name, shared, width)
            for pdf in batches:
                yield pdf[[not verdict(*m.scan(t))[3] for t in pdf.text]]

        return like_input(docs, step)
    bad = decontamination(docs, benchmark, width, block_words).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows are compared as joined strings; places are sums of the lengths of words and of what is between.
OP3_SQL = r"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
cut AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n)),
hits AS (SELECT c.rid, c.i, c.n, x.item_id FROM cut c JOIN wins x ON c.g = x.g AND c.n = x.n),
marked AS (SELECT DISTINCT rid, k FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM hits))),
words AS (SELECT rid, count(*) AS n_hit FROM marked GROUP BY rid),
named AS (SELECT rid, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid),
between AS (SELECT rid, w, regexp_split_to_array(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS gap FROM low WHERE rid IN (SELECT rid FROM words)),
sizes AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(list_transform(w, lambda x: length(x))) AS n, unnest(list_transform(gap[1:len(w)], lambda x: length(x))) AS g FROM between),
ends AS (SELECT rid, k, n, sum(n + g) OVER (PARTITION BY rid ORDER BY k) AS stop FROM sizes),
isles AS (SELECT m.rid, min(e.stop - e.n) AS a, max(e.stop) AS b FROM (SELECT rid, k, k - row_number() OVER (PARTITION BY rid ORDER BY k) AS isle FROM marked) m JOIN ends e ON e.rid = m.rid AND e.k = m.k GROUP BY m.rid, m.isle),
ranges AS (SELECT rid, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) AS VARCHAR), ';' ORDER BY a) AS spans FROM isles GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM low LEFT JOIN words USING (rid) LEFT JOIN named USING (rid) LEFT JOIN ranges USING (rid)
"""
