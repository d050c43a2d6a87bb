"""Mixing sources to target weights by the cube method.

Every source has a target of words; a document of it is taken ``target / size of
source`` times in expectation, between 0 and 2.  The whole part is taken for
certain, the fraction is an inclusion probability.  The cube method moves the
vector of these probabilities inside the null space of two constraints, the
number of documents and the number of words, until each is 0 or 1 but for a few.

The flight runs in blocks of at most about ``BLOCK`` documents of one source, so
a source with a third of all rows is many groups.  A block leaves two undecided
documents at most; these few form the next level's blocks, which hold the same
two totals over whole sources, and so on until one block per source is left.
There the landing gives up the document total first, then the words.

Cases: null and wordless texts have size 0 and are taken with 0 words; a source
without words has target 0; a null source is a source, the last one; repeated
rows are drawn one by one; null ids are allowed; an empty table gives no rows.
Draws depend on ids, sizes and ``SEED`` only, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_RE, Store, table

WEIGHTS, SHARE, MOST, BLOCK, SEED = (3, 1, 2), 1.5, 2.0, 4096, 29
KEPT = 500_000  # decisions that are broadcast to the rows they were made for, about 200 bytes each
TAKEN = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACED_RE)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: n, source_size, target.

    Sources fill up in the order of ``most * size / weight``: those before the
    water level are full, the others share what is left by weight.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = (
        per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
        .withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    )
    water = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(every)["level"]
    return per.select("source", "n", "source_size", F.least(F.col("cap"), F.coalesce(water, F.lit(float("inf"))) * F.col("w")).alias("target"))


def flight(p: list[float], s: list[float], rng) -> list[int]:
    """Moves ``p`` in place; the positions that stay undecided, two at most.

    Three undecided units always have a direction that keeps sum(p) and
    sum(p * s): the cross product of (1, 1, 1) and their sizes.
    """
    waiting = iter(range(len(p)))
    live: list[int] = []
    for i in waiting:
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        while len(live) == 3 or len(live) == 2 and s[live[0]] == s[live[1]]:
            if len(live) == 2:
                u = (1.0, -1.0)
            else:
                a, b, c = (s[j] for j in live)
                u = (c - b, a - c, b - a) if a != b or b != c else (1.0, -1.0, 0.0)
            _move(p, live, u, rng)
            live = [j for j in live if EPS < p[j] < 1 - EPS]
    return live


def _move(p: list[float], live: list[int], u, rng) -> None:
    up = min((1 - p[j]) / x if x > 0 else p[j] / -x for j, x in zip(live, u) if x)
    down = min(p[j] / x if x > 0 else (1 - p[j]) / -x for j, x in zip(live, u) if x)
    step = up if rng.random() * (up + down) < down else -down
    for j, x in zip(live, u):
        q = p[j] + step * x
        p[j] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q


def landing(p: list[float], s: list[float], live: list[int], rng) -> None:
    """Decides the last units: words are kept before documents, then chance."""
    while len(live) == 2:
        a, b = s[live[0]], s[live[1]]
        _move(p, live, (b, -a) if a or b else (1.0, -1.0), rng)
        live = [j for j in live if EPS < p[j] < 1 - EPS]
    for j in live:
        p[j] = float(rng.random() < p[j])


def _group(land: bool, seed: int):
    def step(key, pdf):
        pdf = pdf.sort_values(["draw", "doc_id", "size"], kind="stable")
        name = "" if key[0] is None or pd.isna(key[0]) else "=" + key[0]
        rng = np.random.Generator(np.random.Philox(key=[seed * 2 + land, zlib.crc32(f"{name}|{int(key[1])}".encode())]))
        p, s = pdf.p.tolist(), [float(x) for x in pdf["size"]]
        live = flight(p, s, rng)
        if land:
            landing(p, s, live, rng)
        return pdf.assign(p=p)

    return step


def copies(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Every row of ``sized`` with source_size, target and the number of copies."""
    spark = sized.sparkSession
    store = Store(spark, "mixing")
    sized = store.put(sized)
    per = store.put(targets(sized, weights, share, most))
    most_docs = per.agg(F.max("n")).first()[0] or 0
    per = per.select(F.col("source").alias("s"), F.col("n"), "source_size", "target")
    rows = (
        sized.join(per, sized.source.eqNullSafe(per.s))
        .withColumn("mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.least(F.floor("mean"), F.lit(int(most))).cast("int"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("mean") - F.col("whole")).otherwise(0.0))
        .withColumn("draw", F.xxhash64("doc_id", "size", F.lit(seed)))
        .withColumn("blocks", F.ceil(F.col("n") / block))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "draw", "blocks")
    )
    settled = None
    groups = max(1, -(-most_docs // block))
    level = 0
    while True:
        last = groups == 1
        rows = rows.withColumn("block", F.pmod(F.xxhash64("draw", "doc_id", F.lit(level)), F.greatest("blocks", F.lit(1))).cast("int"))
        fly = rows.groupBy("source", "block").applyInPandas(_group(last, seed + level), rows.schema)
        rows = store.put(fly)
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done = rows if last else rows.where(~undecided)
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        # a block left two rows at most, so the next level is some thousand times smaller
        groups = max(1, -(-2 * groups // block))
        rows = rows.where(undecided).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block)).drop("block")
        level += 1
    return settled.withColumn("copies", F.col("whole") + F.round("p").cast("int")).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text, source) to the words taken of every row."""
    out = copies(sizes(docs), **options)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def taken_rows(docs: DataFrame, most_rows: int = KEPT, **options) -> DataFrame:
    """The rows of ``docs`` of which words are taken: all columns, and the mix's.

    Rows are found again by their id, source and size.  Where these name one row, what the
    mix decided is broadcast to the rows (up to ``most_rows`` decisions of about 200 bytes;
    more are joined by shuffle), so texts stay where they are.  Rows that repeat all three
    share the copies they got together: each has its whole part, and the first ones by
    task and text the rest, numbered inside tasks, so a row repeated very often is many
    groups.  Columns of ``docs`` named like the mix's give way to them.
    """
    store = Store(docs.sparkSession, "mixing-taken")
    mixed = copies(sizes(docs), **options)
    key = [F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")]
    plan = mixed.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("copies").alias("_c"), F.first("source_size").alias("_source_size"), F.first("target").alias("_target"))
    plan = store.put(plan.where("_c > 0 AND _size > 0"))
    n_one, n_many = plan.agg(F.count_if(F.col("_n") == 1), F.count_if(F.col("_n") > 1)).first()
    size, columns = _fresh(docs, "size_of_text"), [c for c in docs.columns if c not in TAKEN]
    known = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(SPACED_RE)), F.lit(0)).cast("long"))

    def found(rows, n):
        match = known.doc_id.eqNullSafe(rows._doc_id) & known.source.eqNullSafe(rows._source) & (known[size] == rows._size)
        return known.join(F.broadcast(rows) if n <= most_rows else rows.hint("shuffle_hash"), match)

    def shaped(rows, n):
        return rows.select(*columns, F.col(size).alias("mix_size"), F.col("_source_size").alias("mix_source_size"), F.col("_target").alias("mix_target"), n.cast("int").alias("mix_copies"), (F.col(size) * n).alias("mix_taken"))

    one = shaped(found(plan.where("_n = 1"), n_one), F.col("_c"))
    if not n_many:
        return one
    task, at, before = (_fresh(docs, c) for c in ("task_of_row", "place_of_row", "rows_before"))
    many = store.put(found(plan.where("_n > 1"), n_many).withColumn(task, F.spark_partition_id()))
    names = ["_doc_id", "_source", "_size"]
    cells = many.groupBy(*names, task).agg(F.count("*").alias("k"))  # one row for each key and task
    cells = cells.select(*[F.col(c).alias(f"c{c}") for c in names], F.col(task).alias("c_task"), (F.sum("k").over(Window.partitionBy(*names).orderBy(task)) - F.col("k")).alias(before))
    cells = store.put(cells)
    inside = Window.partitionBy(*names, task).orderBy(F.xxhash64("text"))
    match = F.col("_doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("_source").eqNullSafe(F.col("c_source")) & (F.col("_size") == F.col("c_size")) & (F.col(task) == F.col("c_task"))
    numbered = many.withColumn(at, F.row_number().over(inside)).join(cells, match)
    share = F.floor(F.col("_c") / F.col("_n")) + (F.col(before) + F.col(at) <= F.col("_c") % F.col("_n")).cast("int")
    return one.unionByName(shaped(numbered, share).where("mix_copies > 0"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
