"""Quality classifier: a factorisation machine in numpy.

Inputs of a text: hashed words (log frequencies, unit length), structure
statistics and metadata (the stated number of characters against the counted
one).  With weights ``w`` and factors ``V`` the logit is

    w0 + x.w + 1/2 * sum_f ((sum_j V_jf x_j)^2 - sum_j V_jf^2 x_j^2)

the pairwise interactions at a cost linear in the number of non-zero inputs.
Fitted by AdaGrad over small batches on at most ``SAMPLE`` labelled texts outside
the held-out fold (those of the smallest keyed hash); every text is scored whole.
Labels, lang, source and doc_id are never inputs of a score.

What the driver receives of a text are at most BUCKETS + STATS indices and values of 8
bytes together: 66 KB a text, however long it is, for ``SAMPLE`` texts at most.

Cases: null and empty texts have only structure inputs and get a score as well;
a very long text is scored whole; a null n_chars counts as agreeing; repeated rows score
alike; ties of the keyed hash are ordered by id, and a score of exactly the threshold is
label 1; without labels, or with labels of one class only, the score is the smoothed share
of label 1; a null doc_id is not learned from and not held out; an empty table gives no
rows; columns other than doc_id, text and n_chars (in the labels doc_id and quality) are not
read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, fold, held_out, table

SAMPLE, SEED, FACTORS, BUCKETS = 5000, 23, 6, 1 << 13
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
STATS = 22


def structure(raw: bytes, words: list[bytes], counts: Counter, n_chars: float | None) -> list[float]:
    """Statistics of the form of a text, each about 0 to 1 in size."""
    n, k = max(1, len(raw)), max(1, len(words))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    lines = raw.split(b"\n")
    line_n = Counter(lines)
    ends = Counter(w[-2:] for w in words)
    letters = of[97:123].sum() + of[65:91].sum() + of[128:].sum()
    chars = n - of[128:192].sum()
    stated = chars if n_chars is None or n_chars != n_chars else n_chars
    return [
        math.log1p(n) / 12,
        math.log1p(k) / 10,
        min(1.0, letters / n),
        of[65:91].sum() / n,
        of[48:58].sum() / n,
        min(1.0, 5 * of[33] / k),
        min(1.0, (of[35] + of[36] + of[37] + of[38] + of[42]) / k),
        min(1.0, of[124] / k),
        min(1.0, 4 * (of[44] + of[46]) / k),
        min(1.0, 10 * of[10] / k),
        len(counts) / k,
        max(counts.values(), default=0) / k,
        1 - len(line_n) / len(lines),
        max(line_n.values()) / len(lines),
        min(1.0, n / k / 12),
        min(1.0, max((len(w) for w in words), default=0) / 40),
        ends.get(b"!!", 0) / k,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / k,
        sum(1 for w in words if len(w) == 1) / k,
        min(1.0, (of[60] + of[62] + of[123] + of[125] + of[61] + of[59]) / k),
        min(1.0, abs(math.log1p(stated) - math.log1p(chars))),
        float(k < 12),
    ]


def inputs(text: str | None, n_chars=None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: structure first, then hashed words."""
    raw = encode(text)
    words = raw.split()
    counts = Counter(words)
    buckets: dict[int, int] = {}
    for w, c in Counter(raw.lower().split()).items():
        b = STATS + zlib.crc32(w) % BUCKETS
        buckets[b] = buckets.get(b, 0) + c
    val = np.log1p(np.fromiter(buckets.values(), float, len(buckets)))
    if len(val):
        val /= np.sqrt(val @ val)
    stats = np.array(structure(raw, words, counts, n_chars))
    return np.concatenate([np.arange(STATS), np.fromiter(buckets, np.int64, len(buckets))]), np.concatenate([stats, val])


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        z = self.w0 + self.w[idx] @ val + 0.5 * float(s @ s - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 20, batch: int = 256, rate: float = 0.15, l2: float = 2e-5, seed: int = SEED) -> Machine:
    dims, y = STATS + BUCKETS, np.array(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(math.log(share / (1 - share)), np.zeros(dims), np.zeros((dims, FACTORS)))
    if len(set(labels)) < 2:
        return m
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.05, (dims, FACTORS))
    seen_w, seen_v, seen_0 = np.full(dims, 1e-3), np.full((dims, FACTORS), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            part = order[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            ends = np.cumsum([len(rows[i][0]) for i in part])
            owner = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
            vx = m.v[idx] * val[:, None]
            s = np.add.reduceat(vx, np.concatenate([[0], ends[:-1]]), axis=0)
            z = m.w0 + np.bincount(owner, m.w[idx] * val, len(part)) + 0.5 * ((s * s).sum(1) - np.bincount(owner, (vx * vx).sum(1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            uniq, pos = np.unique(idx, return_inverse=True)
            gx = g[owner] * val
            gw = np.bincount(pos, gx, len(uniq)) + l2 * m.w[uniq]
            gv = np.stack([np.bincount(pos, gx * (s[owner, f] - vx[:, f]), len(uniq)) for f in range(FACTORS)], 1) + l2 * m.v[uniq]
            seen_w[uniq] += gw * gw
            seen_v[uniq] += gv * gv
            seen_0 += g.sum() ** 2
            m.w[uniq] -= rate * gw / np.sqrt(seen_w[uniq])
            m.v[uniq] -= 0.3 * rate * gv / np.sqrt(seen_v[uniq])
            m.w0 -= rate * g.sum() / math.sqrt(seen_0)
    return m


def _input_rows(batches):
    for pdf in batches:
        made = [inputs(t, c) for t, c in zip(pdf.text, pdf.n_chars)]
        yield pd.DataFrame({"doc_id": pdf.doc_id, "quality": pdf.quality, "idx": [a.astype("<i4").tobytes() for a, _ in made], "val": [b.astype("<f4").tobytes() for _, b in made]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Machine:
    known = labels.select("doc_id", "quality").where(fold() != 0).where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    # a fixed number of rows, so the broadcast is bounded
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(picked), "doc_id").mapInPandas(_input_rows, "doc_id long, quality int, idx binary, val binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.idx)))
    return fit([(np.frombuffer(r.idx, "<i4").astype(np.int64), np.frombuffer(r.val, "<f4").astype(float)) for r in rows], [int(r.quality == 1) for r in rows])


def quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """A score for every row of ``docs`` (doc_id, text, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def step(batches):
        m = Machine(*shared.value)
        for pdf in batches:
            score = [m.score(*inputs(t, c)) for t, c in zip(pdf.text, pdf.n_chars)]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": [not pd.isna(d) and held_out(d) for d in pdf.doc_id], "score": score, "predicted": [int(s >= THRESHOLD) for s in score]}).astype({"held_out": bool, "score": float, "predicted": "int32"})

    return docs.select("doc_id", "text", "n_chars").mapInPandas(step, SCHEMA)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
