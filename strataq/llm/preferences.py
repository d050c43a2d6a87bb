"""Preference formatting: one prompt, two masked completions.

A pair has a chosen and a rejected conversation.  Their longest common prefix of
turns (same role and text) is rendered once as the prompt; the turns after it
are the two completions, each with a loss mask over its characters that covers
what the assistant says and nothing else.  Where one conversation is a prefix of
the other, its completion is empty.

``pair_up`` makes pairs of a table of conversations.  Conversations with the same
first turn are mixed by a keyed hash into bins of at most about ``BIN``; inside a
bin neighbours are paired, first with second, third with fourth.  Bins bound
what one task holds, whatever the number of conversations behind a first turn.
The last of an odd bin is returned alone: all of it is the chosen completion, the
prompt is empty and nothing is rejected.  Of a pair, the one with more assistant
characters is chosen; ties go to the lower id.  How many share a first turn is asked only
of those that fill more than a bin: up to ``HOT_TURNS`` of them (40 bytes each) are
broadcast, more are joined by a shuffle that can be split, as the counts are written first.

Cases: a null text is the empty text, a null role is ``user``; turns are ordered
by number, then role and text; exactly repeated turns count once; a very long text is kept
whole; rows without conv_id are left out, as nothing says where they belong; an empty table
gives no rows; columns other than conv_id, turn, role and text are not read, whatever their
names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, table

BIN = 64
HOT_TURNS = 500_000
OPEN, CLOSE, VOICE = "<|{}|>\n", "<|end|>\n", "assistant"
SCHEMA = (
    "chosen_id long, rejected_id long, n_common int, prompt string, chosen string, chosen_mask array<array<int>>, "
    "rejected string, rejected_mask array<array<int>>"
)


def render(turns) -> str:
    return "".join(OPEN.format(role) + text + CLOSE for role, text in turns)


def masked(turns) -> tuple[str, list[list[int]]]:
    """Text of a completion and the [start, end) ranges that count in the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN.format(role)
        parts += [head, text, CLOSE]
        if role == VOICE:
            spans.append([at + len(head), at + len(head) + len(text) + len(CLOSE)])
        at += len(head) + len(text) + len(CLOSE)
    return "".join(parts), spans


def split_pair(a: list, b: list) -> int:
    """Number of turns that both begin with."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def pair_up(convs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """conv_id, turns to chosen_id, chosen, rejected_id, rejected (null if alone)."""
    keyed = convs.withColumn("first", F.unhex(F.sha2(F.concat_ws("\x00", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)))
    counts = Store(convs.sparkSession, "preferences").put(keyed.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > bin_size))
    if counts.count() <= HOT_TURNS:
        counts = F.broadcast(counts)
    voice = F.aggregate("turns", F.lit(0), lambda s, t: s + F.when(t["role"] == VOICE, F.length(t["text"])).otherwise(0))
    binned = (
        keyed.join(counts, "first", "left")
        .withColumn("bin", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id"), F.ceil(F.col("n") / bin_size))))
        # one key of both, or the rows would stay where the join by first turn has put them
        .withColumn("cell", F.concat_ws(":", F.hex("first"), "bin"))
        .withColumn("side", F.struct((-voice).alias("less"), F.col("conv_id").alias("id"), F.col("turns")))
    )
    bins = Window.partitionBy("cell").orderBy(F.xxhash64("conv_id"), "conv_id")
    paired = binned.select("side", F.lead("side").over(bins).alias("next"), F.row_number().over(bins).alias("k")).where("k % 2 = 1")
    swap = F.col("next").isNotNull() & (F.struct(F.col("next.less"), F.col("next.id")) < F.struct(F.col("side.less"), F.col("side.id")))
    return paired.select(
        F.when(swap, F.col("next")).otherwise(F.col("side")).alias("c"), F.when(swap, F.col("side")).otherwise(F.col("next")).alias("r")
    ).select(F.col("c.id").alias("chosen_id"), F.col("c.turns").alias("chosen"), F.col("r.id").alias("rejected_id"), F.col("r.turns").alias("rejected"))


def _turns(x) -> list | None:
    return None if x is None else [(t["role"], t["text"]) for t in x]


def _step(batches):
    for pdf in batches:
        rows = []
        for cid, c, rid, r in zip(pdf.chosen_id, pdf.chosen, pdf.rejected_id, pdf.rejected):
            c, r = _turns(c) or [], _turns(r)
            n = 0 if r is None else split_pair(c, r)
            yes, no = masked(c[n:]), (None, None) if r is None else masked(r[n:])
            rows.append((cid, rid, n, render(c[:n]), *yes, *no))
        out = pd.DataFrame(rows, columns=["chosen_id", "rejected_id", "n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"])
        yield out.astype({"chosen_id": "Int64", "rejected_id": "Int64", "n_common": "int32"})


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of every pair."""
    return pairs.select("chosen_id", "chosen", "rejected_id", "rejected").mapInPandas(_step, SCHEMA)


def op5_preferences(spark, sf_dir: str) -> DataFrame:
    return format_pairs(pair_up(conversations(table(spark, sf_dir, "conversations"))))
