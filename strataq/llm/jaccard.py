"""Jaccard self-join of word n-gram sets with a prefix tree.

A text's set holds its distinct ``n``-word shingles, as 64-bit hashes.  Texts
with equal sets are one *node*.  Two nodes link if ``100 * |A & B|`` is at least
``percent * |A | B|``; documents get the least doc_id they can reach by links.

1. All n-grams are put into one global order, rare ones first.  How common one is
   comes from counts over all documents; only n-grams that repeat inside a task
   are counted, and at most ``COMMON`` of them are broadcast, the most frequent.
   The others, far more in a large table, are ordered by their words: the sum of the
   logarithms of how often these occur (at most ``WORDS`` counts are broadcast), so
   that n-grams of frequent words, which texts share by chance, come late.
   Any order is right: it decides the work, not the result.
2. Nodes that can link share an n-gram among the first ``|A| - ceil(t|A|) + 1``
   of each in that order.  Owners of one n-gram are sorted by size.  Up to
   ``PAIRS`` owners are paired, unless sizes or the places of the n-gram in both
   orders rule a pair out; what is left must also pass a bound by sketches: the
   L1 distance of two histograms of hashed n-grams is at most the size of the
   symmetric difference.  Of more owners, neighbours by size are chained while
   their sizes are compatible, so compatible owners always end up connected.
   The connected parts are the *clusters* of candidates.  An n-gram with very
   many owners is dealt out in parts that are linked among each other.
   Chains through n-grams that texts share by chance can connect much of a large table.
   So nodes of clusters beyond ``UNIT`` n-grams get new prefixes, in an order in which the
   n-grams that had more than ``PAIRS`` owners come last, and new clusters inside the old
   ones, at most ``ROUNDS`` times; a group of near copies stays as it is.
3. Clusters of at most ``UNIT`` n-grams share units of about that size.  A larger one is
   worked on in two rounds.  First every block of half a unit is joined with itself and with
   a fixed share of the cluster of at most about that size, the *pivots*: what is shipped is
   about twice the cluster.  Members linked by now are one part already, so the second round
   leaves pairs inside the largest part out: it joins the *rest* of the cluster with itself
   and with the largest part, in pairs of blocks of one band of sizes or of neighbouring ones
   (bands are as wide as the threshold allows, so no pair that can link is missed).  Of a
   group of near copies the rest is small, and the work stays in proportion to the cluster.
4. In a unit the sets go into a prefix tree in the unit's order (again rare ones
   first).  A probe walks down with its overlap so far; a subtree is left where
   neither its longest nor its shortest set can still reach the threshold with
   the n-grams that remain, or where all its sets are linked with the probe
   already.  Links found are united at once.  What is shipped to units are the n-grams
   of candidate nodes, found again by the name of the set and not by the doc_id alone.

Tables that a later step needs no more are deleted, and so are the shuffle files of finished
steps; what is left behind the result is two narrow tables.  Pairs by chance grow with the
square of the table, so sketches are brought to at most ``SLICE`` pairs at once.

Cases: null and wordless texts have an empty set, link with nothing and keep
their own id; a text of fewer than ``n`` words has its whole sequence as its one
shingle; a very long text is one set, and its unit is as large as it is; ties of size are
ordered by the set's name; repeated rows share a set; rows that repeat a doc_id with another
text are judged by their own sets; rows with a null doc_id are returned but not
linked (component null), as no id names them; an empty table gives no rows; columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import Store, spaced_words, table

N, PERCENT = 4, 85
COMMON = 1 << 19  # n-grams whose frequency class is broadcast: 9 bytes each
WORDS = 1 << 18  # words whose frequency class is broadcast, the same
CHUNK = 1 << 21  # n-grams counted together inside a task
UNIT = 400_000  # n-grams of one unit of work
HOT, PART = 1024, 512  # owners of an n-gram above which it is dealt out, and of one part
PAIRS = 32  # owners of an n-gram that are paired; more are chained
ROUNDS = 3  # times that large clusters are taken apart by a better order
SLICE = 4_000_000  # pairs that get sketches at once, some 350 bytes a pair
BROADCAST = 200_000  # rows of up to 40 bytes that say where a set is needed; more are joined by shuffle
GONE = SEATS = 2_000_000  # ids, and (id, set) pairs, that are broadcast: 8 and 16 bytes each; more are joined by shuffle
SEEN = 1 << 17  # names of sets that a task remembers in order not to repeat their n-grams
STEP = 16  # n-grams of one edge of the tree

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _windows(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-word shingles of a text, in its order, and of its words."""
    words = spaced_words(text)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not words:
        return h, h
    k = min(n, len(words))
    x = np.full(len(words) - k + 1, 0x9E3779B97F4A7C15 * k % 2**64, np.uint64)
    for i in range(k):
        x = _mix(x + h[i : len(h) - k + 1 + i])
    return x, h


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""
    return np.unique(_windows(text, n)[0])


def set_id(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams))).astype(np.int64))


def _counted(n: int):
    def step(batches):
        chunk, words, size, seen = [], [], 0, set()
        for pdf in batches:
            for text in pdf.text:
                x, h = _windows(text, n)
                g = np.unique(x)
                if len(g) and (name := set_id(g)) not in seen:
                    seen.add(name)
                    chunk.append(g)
                    words.append(h)
                    size += len(g)
            if size >= CHUNK:
                yield from _repeats(chunk, False)
                yield from _repeats(words, True)
                chunk, words, size, seen = [], [], 0, set()
        yield from _repeats(chunk, False)
        yield from _repeats(words, True)

    return step


def _repeats(chunk, word: bool):
    if chunk:
        gram, count = np.unique(np.concatenate(chunk), return_counts=True)
        keep = count > 1
        gram, count = gram[keep].astype(np.int64), count[keep]
        for at in range(0, len(gram), 1 << 16):
            yield pd.DataFrame({"word": word, "gram": gram[at : at + (1 << 16)], "k": count[at : at + (1 << 16)].astype(np.int64)})


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    least, total = 256, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # 256 rows at most
        if total + row["count"] > most:
            break
        least, total = row["level"], total + row["count"]
    got = counts.where(F.col("level") >= least).select("gram", "level").toArrow()
    gram = got["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], got["level"].to_numpy().astype(np.uint8)[order]


def common_ngrams(docs: DataFrame, store: Store, n: int = N, most: int = COMMON, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """The most frequent n-grams, ascending, and their class 4 * log2(count); the same of words."""
    level = F.least(F.floor(F.log2("k") * 4), F.lit(255)).cast("int")
    found = docs.select("text").mapInPandas(_counted(n), "word boolean, gram long, k long")
    counts = store.put(found.groupBy("word", "gram").agg(F.sum("k").alias("k")).select("word", "gram", level.alias("level")))
    out = *_frequent(counts.where("NOT word"), most), *_frequent(counts.where("word"), words)
    store.drop(counts)
    return out


def _classes(names: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Class of each name, 0 of one that is not known."""
    if not len(known):
        return np.zeros(len(names), np.uint8)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, level[at], 0).astype(np.uint8)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def sketch(grams: np.ndarray) -> bytes:
    """Histogram of the n-grams over a number of buckets that follows their number."""
    buckets = 1 << min(14, max(6, (len(grams) // 8).bit_length()))
    counts = np.bincount((grams >> np.uint64(40)).astype(np.int64) & (buckets - 1), minlength=buckets)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int = PERCENT) -> bool:
    """False only if the sketches show that the sets differ too much."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    k = min(len(x), len(y))
    apart = np.abs(x.reshape(-1, k).sum(0) - y.reshape(-1, k).sum(0)).sum()
    return apart * (100 + percent) <= (100 - percent) * (na + nb)


def _prefixes(shared, n: int, percent: int):
    def step(batches):
        gram, level, word, often = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint64, np.uint8) * 2))
        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                x, h = _windows(text, n)
                g, spot = np.unique(x, return_index=True)
                if not len(g):
                    rows.append((doc, None, 0, None, None, None, None))
                    continue
                name = set_id(g)
                if name in seen or pd.isna(doc):
                    rows.append((doc, name, len(g), None, None, None, None))
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                of = _classes(g, gram, level)
                upto = np.concatenate([[0], np.cumsum(_classes(h, word, often), dtype=np.int64)])
                weight = (upto[len(upto) - len(x) :] - upto[: len(x)])[spot]
                first = np.lexsort((weight, of))[: prefix_length(len(g), percent)]
                # the order is by level, so what is dealt out in parts comes last
                cut = int(np.searchsorted(of[first], 4 * int(math.log2(HOT))))
                parts = (2.0 ** (of[first[cut:]] / 4.0) / PART).astype(np.int64)
                rows.append((doc, name, len(g), g[first[:cut]].view(np.int64), g[first[cut:]].view(np.int64), parts, sketch(g)))
            out = dict(zip(("grams", "hot", "parts", "sketch"), ([r[k] for r in rows] for k in (3, 4, 5, 6))))
            ids = {k: pd.array([None if pd.isna(r[i]) else r[i] for r in rows], "Int64") for i, k in enumerate(("doc_id", "node"))}
            yield pd.DataFrame(ids | {"n_shingles": [r[2] for r in rows]} | out)

    return step


NAMED = "doc_id long, node long, n_shingles long, grams array<long>, hot array<long>, parts array<long>, sketch binary"


def _owners(percent: int):
    """Rows sorted by (gram, size and place, node) to (a, b, sure): see step 2.

    Only the last group of a batch is carried on; of one that grows beyond a
    bound, its last row.
    """

    def links(gram, size, place, node, grown):
        keep = np.ones(len(gram), bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, size, place, node = gram[keep], size[keep], place[keep], node[keep]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        count = np.repeat(np.diff(np.append(start, len(gram))), np.diff(np.append(start, len(gram))))
        few = count <= PAIRS
        if grown:
            few &= gram != gram[0]
        found = []
        for d in range(1, PAIRS):
            if len(gram) <= d:
                break
            i = np.flatnonzero((gram[d:] == gram[:-d]) & (few[d:] | (d == 1)))
            j = i + d
            i, j = i[ok := 100 * size[i] >= percent * size[j]], j[ok]
            most = np.minimum(place[i], place[j]) + 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1)
            ok = ~few[i] | ((100 + percent) * most >= percent * (size[i] + size[j]))
            found.append(np.stack([node[i], node[j], ~few[i]], 1)[ok])
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1], "sure": out[:, 2].astype(bool)})

    def step(batches):
        held, grown = None, False
        for pdf in batches:
            rows = pdf[["gram", "sized", "node"]].to_numpy()
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield links(*_columns(rows[:last]), grown)
                held, grown = rows[last:], False
            else:
                held = rows
            if len(held) > 1 << 16:
                yield links(*_columns(held), True)
                held, grown = held[-1:], True
        if held is not None:
            yield links(*_columns(held), grown)

    return step


def _columns(rows: np.ndarray):
    return rows[:, 0], rows[:, 1] >> 32, rows[:, 1] & 0xFFFFFFFF, rows[:, 2]


def _chain(batches):
    """Rows sorted by (gram, part, node): each later node with the first of its group.

    The first node of a part comes out once more, with its gram and no partner.
    """
    last, anchor = None, None
    for pdf in batches:
        gram, part, node = pdf.gram.to_numpy(), pdf.part.to_numpy(), pdf.node.to_numpy()
        if not len(gram):
            continue
        new = np.empty(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
        new[0] = last != (gram[0], part[0])
        start = np.maximum.accumulate(np.where(new, np.arange(len(gram)), -1))
        first = np.where(start >= 0, node[np.maximum(start, 0)], -1 if anchor is None else anchor)
        last, anchor = (gram[-1], part[-1]), first[-1]
        link = ~new & (first != node)
        pairs = pd.DataFrame({"gram": 0, "a": node[link], "b": first[link]}).drop_duplicates()
        again = pd.DataFrame({"gram": gram[new & (part > 0)], "a": node[new & (part > 0)], "b": None})
        yield pd.concat([pairs, again.astype({"b": "Int64"})]).astype({"gram": "int64", "a": "int64", "b": "Int64"})


def _sketched(percent: int):
    def step(batches):
        for pdf in batches:
            keep = [s or may_link(x, y, m, n, percent) for s, x, y, m, n in zip(pdf.sure, pdf.sa, pdf.sb, pdf.na, pdf.nb)]
            yield pdf.loc[keep, ["a", "b"]]

    return step


def candidates(named: DataFrame, nodes: DataFrame, store: Store, percent: int = PERCENT) -> DataFrame:
    """(a, b) edges whose connected parts hold every pair of nodes that can link."""
    plain = named.where("grams IS NOT NULL").select("node", "n_shingles", F.posexplode("grams").alias("place", "gram"))
    plain = plain.select("gram", (F.shiftleft(F.col("n_shingles"), 32) + F.col("place")).alias("sized"), "node")
    found = store.put(plain.repartition("gram").sortWithinPartitions("gram", "sized", "node").mapInPandas(_owners(percent), "a long, b long, sure boolean"))
    store.sweep()
    pairs = store.put(found.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))
    store.drop(found)
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    slices, likely = max(1, -(-pairs.count() // SLICE)), []
    for i in range(slices):
        mine = pairs.where(F.pmod(F.xxhash64("a", F.lit("slice")), F.lit(slices)) == i) if slices > 1 else pairs
        likely.append(store.put(mine.join(side("a"), "a").join(side("b"), "b").mapInPandas(_sketched(percent), "a long, b long")))
        store.sweep()
    store.drop(pairs)
    likely = reduce(DataFrame.unionByName, likely)
    hot = named.where("size(hot) > 0").select("node", F.explode(F.arrays_zip("hot", "parts")).alias("h"))
    hot = hot.select("node", F.col("h.hot").alias("gram"), (F.pmod(F.xxhash64("node"), F.col("h.parts")) + 1).cast("int").alias("part"))

    def group(rows):
        return rows.repartition("gram", "part").sortWithinPartitions("gram", "part", "node").mapInPandas(_chain, "gram long, a long, b long")

    chained = store.put(group(hot))
    heads = group(chained.where("b IS NULL").select(F.col("a").alias("node"), "gram", F.lit(0).alias("part")))
    return likely.unionByName(chained.where("b IS NOT NULL").select("a", "b")).unionByName(heads.where("b IS NOT NULL").select("a", "b"))


class Tree:
    """Prefix tree of ordered sets; every edge has up to STEP n-grams.

    A node is [grams, children by first gram, shortest, longest, sets that end
    here, one set all below are linked with or -1].
    """

    def __init__(self, percent: int):
        self.percent, self.root = percent, [(), {}, 1 << 60, 0, [], None]
        self.parent: list[int] = []
        self.sets: list[tuple] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, grams: tuple) -> int:
        self.parent.append(len(self.parent))
        self.sets.append(grams)
        return len(self.parent) - 1

    def insert(self, i: int) -> None:
        grams, node, at = self.sets[i], self.root, 0
        size = len(grams)
        self._pass(node, i, size)
        while at < size:
            child = node[1].get(grams[at])
            if child is None:
                child = [grams[at : at + STEP], {}, 1 << 60, 0, [], None]
                node[1][grams[at]] = child
            else:
                label, k = child[0], 1
                while k < len(label) and at + k < size and label[k] == grams[at + k]:
                    k += 1
                if k < len(label):  # split the edge
                    upper = [label[:k], {label[k]: child}, child[2], child[3], [], child[5]]
                    child[0] = label[k:]
                    node[1][grams[at]] = child = upper
            self._pass(child, i, size)
            node, at = child, at + len(child[0])
        node[4].append(i)

    def _pass(self, node: list, i: int, size: int) -> None:
        node[2], node[3] = min(node[2], size), max(node[3], size)
        if node[5] is None:
            node[5] = i
        elif node[5] >= 0 and self.find(node[5]) != self.find(i):
            node[5] = -1

    def probe(self, i: int) -> None:
        """Unites set ``i`` with every set of the tree that reaches the threshold."""
        grams, p = self.sets[i], self.percent
        mine, size, home, find = frozenset(grams), len(grams), self.find(i), self.find
        low, high = -(-p * size // 100), 100 * size // p
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, over = stack.pop()
            for j in node[4]:
                if low <= depth <= high and (100 + p) * over >= p * (size + depth):
                    self.parent[find(j)] = home
            for child in node[1].values():
                label, _, short, long, _, linked = child
                if long < low or short > high or linked >= 0 and find(linked) == home:
                    continue
                o, d = over + len(mine.intersection(label)), depth + len(label)
                long, short = min(long, high), max(short, low)
                # the longest set below may match all it has left, the shortest all that the probe has left
                if (100 + p) * (o + long - d) < p * (size + long):
                    continue
                if (100 + p) * (o + size - bisect_right(grams, label[-1])) < p * (size + short):
                    continue
                stack.append((child, d, o))


def join_unit(sets: list[np.ndarray], sides: list[int], percent: int = PERCENT, known: list | None = None) -> list[int]:
    """For each set the position of one set it is linked with, through links, or its own.

    Side 0 is only inserted, side 1 only probes, side 2 does both.  Sets with the same
    ``known`` part are linked from the start.
    """
    sizes = [len(s) for s in sets]
    gram, pos, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, count))] = np.arange(len(gram))
    ordered = [np.sort(x) for x in np.split(rank[pos], np.cumsum(sizes)[:-1])]
    tree = Tree(percent)
    for x in ordered:
        tree.add(tuple(x.tolist()))
    first: dict = {}
    for i, part in enumerate(known if known is not None else ()):
        tree.parent[i] = first.setdefault(part, i)
    for i in sorted(range(len(sets)), key=lambda i: (sides[i] == 1, sizes[i])):
        if sides[i]:
            tree.probe(i)
        if sides[i] != 1:
            tree.insert(i)
    return [tree.find(i) for i in range(len(sets))]


def _unit_join(percent: int):
    def step(pdf):
        node, cluster, side, part, grams = (pdf[c].to_numpy() for c in ("node", "cluster", "side", "part", "grams"))
        order = np.lexsort((-side, node, cluster))  # of a pivot in its own block, the row that probes
        order = order[np.concatenate([[True], node[order[1:]] != node[order[:-1]]])]
        found = []
        for mine in np.split(order, np.flatnonzero(cluster[order[1:]] != cluster[order[:-1]]) + 1):
            if len(mine) > 1:
                root = join_unit([np.frombuffer(grams[i], np.uint64) for i in mine], side[mine].tolist(), percent, part[mine].tolist())
                found.append(np.stack([part[mine], part[mine[root]]]))
        a, b = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()

    return step


def _wanted(n: int):
    """Rows (node, text) to (node, grams), for the rows whose set has that name."""

    def step(batches):
        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for node, text in zip(pdf.node, pdf.text):
                if node not in seen and set_id(g := ngrams(text, n)) == node:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(node)
                    rows.append((node, g.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "grams"]).astype({"node": "int64"})

    return step


def _blocks(rows: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Number of blocks of about ``half`` n-grams for each of ``keys``."""
    return rows.groupBy(*keys).agg(F.ceil(F.sum("n_shingles") / half).cast("int").alias("blocks"))


def first_round(large: DataFrame, half: int) -> DataFrame:
    """(node, cluster, n_shingles, weight) to (node, cluster, unit, side): blocks and pivots."""
    cut = large.withColumn("blocks", F.ceil(F.col("weight") / half).cast("int"))
    own = cut.select("node", "cluster", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("unit"), F.lit(2).alias("side"))
    pivots = cut.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("blocks")) == 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.unionByName(pivots.select("node", "cluster", F.xxhash64("cluster", "j").alias("unit"), F.lit(0).alias("side")))


def second_round(rest: DataFrame, main: DataFrame, store: Store, percent: int, half: int) -> DataFrame:
    """The same for pairs with a node of ``rest``: of one band of sizes or neighbouring ones."""
    width = -math.log(percent / 100) * 1.0001
    band = F.floor(F.log("n_shingles") / width).cast("int")
    rest, main = rest.withColumn("band", band), main.withColumn("band", band)
    r, m = (store.put(_blocks(x, ["cluster", "band"], half)) for x in (rest, main))

    def dealt(rows, blocks):
        return rows.join(blocks, ["cluster", "band"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def facing(rows, others, step, name, side):
        """Rows with every block of the others' band ``step`` above their own."""
        far = others.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias("other"))
        return rows.join(far, ["cluster", "band"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1))).select("node", "cluster", name.alias("unit"), side.alias("side"))

    rest, main = dealt(rest, r), dealt(main, m)
    inside = F.xxhash64(F.lit("rest"), "cluster", "band", "band", F.least("i", "j"), F.greatest("i", "j"))
    out = [facing(rest, r, 0, inside, F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1))]
    out.append(facing(rest, r, 1, F.xxhash64(F.lit("rest"), "cluster", "band", F.col("band") + 1, "i", "j"), F.lit(0)))
    out.append(facing(rest, r, -1, F.xxhash64(F.lit("rest"), "cluster", F.col("band") - 1, "band", "j", "i"), F.lit(1)))
    for step in (-1, 0, 1):
        out.append(facing(rest, m, step, F.xxhash64(F.lit("main"), "cluster", "band", F.col("band") + step, "i", "j"), F.lit(1)))
        out.append(facing(main, r, step, F.xxhash64(F.lit("main"), "cluster", F.col("band") + step, "band", "j", "i"), F.lit(0)))
    return reduce(DataFrame.unionByName, out)


def unit_links(nodes: DataFrame, docs: DataFrame, store: Store, n: int = N, percent: int = PERCENT, most: int = UNIT) -> DataFrame:
    """(node, doc_id, n_shingles, cluster) to edges (a, b) that connect whatever links connect."""
    total = store.put(nodes.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("members")).where("members > 1"))
    few, size = total.where(F.col("weight") <= most), total.agg(F.sum(F.when(F.col("weight") <= most, F.col("weight"))), F.count_if(F.col("weight") > most)).first()
    bins = max(1, -(-(size[0] or 0) // most))  # small clusters share units
    seats = nodes.join(total.select("cluster"), "cluster").select("node", "doc_id")
    side = F.broadcast(seats) if seats.count() <= SEATS else seats.hint("shuffle_hash")
    sets = store.put(docs.join(side, "doc_id").select("node", "text").mapInPandas(_wanted(n), "node long, grams binary"))

    def joined(work: DataFrame) -> DataFrame:
        work = store.put(work)
        side = F.broadcast(work) if work.count() <= BROADCAST else work
        found = store.put(sets.join(side, "node").groupBy("unit").applyInPandas(_unit_join(percent), "a long, b long"))
        store.drop(work)
        store.sweep()
        return found

    alone = F.col("node").alias("part")
    found = joined(nodes.join(few, "cluster").select("node", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("unit"), F.lit(2).alias("side"), alone))
    if size[1]:
        half = max(1, most // 2)
        large = store.put(nodes.join(total.where(F.col("weight") > most).select("cluster", "weight"), "cluster").select("node", "n_shingles", "cluster", "weight"))
        near = joined(first_round(large, half).withColumn("part", F.col("node")))
        parts = store.put(large.join(components(near, store), "node", "left").select("node", "n_shingles", "cluster", F.coalesce("label", "node").alias("part")))
        main = parts.groupBy("cluster", "part").agg(F.sum("n_shingles").alias("w")).groupBy("cluster").agg(F.max_by("part", F.struct("w", "part")).alias("main"))
        split = parts.join(store.put(main), "cluster")
        rest = split.where("part <> main").drop("main")
        found = found.unionByName(near)
        if not rest.isEmpty():
            work = second_round(rest, split.where("part = main").drop("main"), store, percent, half)
            found = found.unionByName(joined(work.join(parts.select("node", "part"), "node")))
    store.drop(sets)
    return found


def _raised(known: tuple[np.ndarray, ...], gram: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """The table of common n-grams with these at their class at least."""
    name, at = np.unique(np.concatenate([known[0], gram]), return_inverse=True)
    top = np.zeros(len(name), np.uint8)
    np.maximum.at(top, at, np.concatenate([known[1], level]))
    return name, top, *known[2:]


def taken_apart(nodes: DataFrame, named: DataFrame, owners: DataFrame, docs: DataFrame, known: tuple[np.ndarray, ...], store: Store, n: int, percent: int, most: int, unit: int) -> DataFrame:
    """(node, doc_id, n_shingles, cluster) with clusters of more than ``unit`` n-grams split where they can be.

    Deletes ``named`` and ``nodes`` as soon as they are replaced, ``named`` in any case.
    """
    spark, before = docs.sparkSession, None
    for _ in range(ROUNDS):
        big = nodes.groupBy("cluster").agg(F.sum("n_shingles").alias("weight")).where(F.col("weight") > unit)
        large = store.put(nodes.join(big.select("cluster"), "cluster"))
        size = large.agg(F.count("*"), F.sum("n_shingles")).first()
        if not size[0] or before and 10 * size[1] > 9 * before:
            break
        before = size[1]
        has = named.where("grams IS NOT NULL").join(large.select("node"), "node").dropDuplicates(["node"])
        level = F.least(F.floor(F.log2("k") * 4), F.lit(255)).cast("int").alias("level")
        many = has.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > PAIRS)
        many = store.put(many.select("gram", level))
        known = _raised(known, *_frequent(many, most))
        shared = spark.sparkContext.broadcast(tuple(x.tobytes() for x in known))
        seats = large.select("doc_id")
        side = F.broadcast(seats) if size[0] <= SEATS else seats.hint("shuffle_hash")
        old, named = named, store.put(docs.join(side, "doc_id").select("doc_id", "text").mapInPandas(_prefixes(shared, n, percent), NAMED))
        store.drop(old, many)
        own = store.put(owners.join(large.select("node"), "node"))
        parts = components(candidates(named, own, store, percent), store)
        split = large.drop("cluster").join(parts.select("node", F.col("label").alias("cluster")), "node")
        # big and split read the old nodes, so these are dropped after the new ones are written
        old, nodes = nodes, store.put(nodes.join(big.select("cluster"), "cluster", "left_anti").unionByName(split))
        store.drop(old, own, large)
        store.sweep()
        shared.destroy()
    store.drop(named)
    return nodes


def jaccard_nodes(docs: DataFrame, store: Store, n: int = N, percent: int = PERCENT, common: int = COMMON, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Written tables (doc_id, node, n_shingles) of all rows and (node, component_id) of all nodes."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    work = store.part("work")
    known = common_ngrams(docs, work, n, common)
    shared = spark.sparkContext.broadcast(tuple(x.tobytes() for x in known))
    named = work.put(docs.mapInPandas(_prefixes(shared, n, percent), NAMED))
    owners = work.put(named.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")))
    clusters = components(candidates(named, owners, work, percent), work)
    rows = store.put(named.select("doc_id", "node", "n_shingles"))
    nodes = work.put(owners.drop("sketch").join(clusters.select("node", F.col("label").alias("cluster")), "node"))
    work.sweep()
    nodes = taken_apart(nodes, named, owners, docs, known, work, n, percent, common, unit)
    label = components(unit_links(nodes, docs, work, n, percent, unit), work)
    own = owners.select("node", F.col("doc_id").alias("own"))
    label = work.put(label.join(own, "node"))
    # written before it is joined, so that a part with many nodes can be split
    least = work.put(label.groupBy("label").agg(F.min("own").alias("least")))
    label = work.put(label.join(least, "label").select("node", "least"))
    every = store.put(own.join(label, "node", "left").select("node", F.coalesce("least", "own").alias("component_id")))
    work.clear()
    work.sweep()
    shared.destroy()
    return rows, every


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows, every = jaccard_nodes(docs, Store(docs.sparkSession, "jaccard"), **options)
    return rows.join(every, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def clean(docs: DataFrame, n: int = N, **options) -> DataFrame:
    """One row, all columns, of each component: that of the least doc_id.

    Texts are not moved: the ids that go are broadcast up to ``GONE`` of them, beyond that
    those that stay (rows are joined by shuffle only where both are more).  Rows that repeat a doc_id are told apart by their sets: of equal
    sets one row stays.  Rows with a null doc_id stay, and so do wordless ones.
    """
    store = Store(docs.sparkSession, "jaccard-clean")
    rows, every = jaccard_nodes(docs, store, n, **options)
    judged = store.put(rows.where("doc_id IS NOT NULL").join(every, "node", "left").select("doc_id", "node", F.coalesce("component_id", "doc_id").alias("component_id")))
    ids = judged.groupBy("doc_id").agg(F.count("*").alias("k"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"))
    ids = store.put(ids.select("doc_id", (F.col("gone") | (F.col("k") > 1)).alias("out"), (F.col("k") > 1).alias("again")))
    store.drop(rows, every)
    store.sweep()
    size = ids.agg(F.count_if("out"), F.count_if("again"), F.count_if(~F.col("out"))).first()
    if size[2] <= GONE < size[0]:
        stays = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids.where("NOT out").select("doc_id")), "doc_id", "left_semi")
        plain = stays.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
    else:
        out = ids.where("out").select("doc_id")
        plain = docs.join(F.broadcast(out) if size[0] <= GONE else out, "doc_id", "left_anti").select(*docs.columns)
    if not size[1]:
        return plain
    again = ids.where("again").select("doc_id")
    extra = "node_of_text"
    while extra in docs.columns:
        extra += "_"
    shape = T.StructType([*docs.schema.fields, T.StructField(extra, T.LongType())])

    def name(batches):
        for pdf in batches:
            pdf[extra] = pd.array([set_id(g) if len(g) else None for g in (ngrams(t, n) for t in pdf.text)], "Int64")
            yield pdf

    many = docs.join(F.broadcast(again) if size[1] <= GONE else again, "doc_id", "left_semi").select(*docs.columns).mapInPandas(name, shape)
    keep = judged.where("node IS NOT NULL AND doc_id = component_id").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct()
    stay = many.join(keep, (F.col("doc_id") == F.col("kept_id")) & (F.col(extra) == F.col("kept_node")), "left_semi").dropDuplicates(["doc_id", extra])
    return plain.unionByName(stay.select(*docs.columns)).unionByName(many.where(F.col(extra).isNull()).select(*docs.columns))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
