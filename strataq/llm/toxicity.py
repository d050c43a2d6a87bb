"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1, outside the held-out fold) are the positives;
a sample of all texts outside that fold, taken without looking at labels, is the
unlabelled side.  With class prior ``pi`` the risk of a classifier ``g`` is

    R(g) = pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

and where the bracket turns negative the step goes against it, as the estimator
asks for.  Classifiers are linear over the presence of words and of word beginnings
that occur once, twice or four times at least; they are fitted in numpy by proximal
gradient steps: the L1 part leaves only features that toxic texts need, so a long
text gathers no noise from its many words.  One classifier is fitted for
each random half of the unlabelled sample; scores are sigmoids of the mean logit.

Bounds (parameters): ``positives`` and ``unlabelled`` texts are fitted on at
most, those of the smallest keyed hash whose features take ``FIT_BYTES`` together on each
side (texts of more than ``TEXT_BYTES`` of features are not fitted on), which is what the
driver receives; every text is scored whole.

Cases: null and wordless texts have only the bias and score low; very long texts are scored
whole; repeated rows score alike; a repeated doc_id is one pick of the sample, with all its
rows; ties of the keyed hash are ordered by id; a score of exactly the threshold counts as
toxic; without any confirmed toxic text every score is 0; a null doc_id is
never used for learning and is not held out; an empty table gives no rows; columns other
than doc_id and text (in the labels doc_id and toxic) are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, fold, held_out, like_input, table

POSITIVES, UNLABELLED, SEED = 1500, 4000, 17
FIT_BYTES, TEXT_BYTES = 64 << 20, 4 << 20
THRESHOLD = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


#: Lengths in bytes of the word beginnings, and how often one must occur.
BEGINNINGS, OFTEN = (5, 7), (1, 2, 4)


def features(text: str | None, known: frozenset | None = None) -> set[bytes]:
    """Words, and ``length:beginning`` for each count reached; only ``known`` ones if given."""
    words = alnum_words(text)
    out = set(words) if known is None else set(known.intersection(words))
    for n in BEGINNINGS:
        head = b"%d:" % n
        for start, k in Counter([w[:n] for w in words if len(w) >= n]).items():
            if known is None or head + start in known:
                out.update(head + start + (b"#%d" % m if m > 1 else b"") for m in OFTEN if k >= m)
    return out if known is None else out & known


def training_texts(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = SEED) -> tuple[list[bytes], list[bytes], float]:
    """Features (joined by spaces) of the positive and the unlabelled sample, and the class prior."""
    known = labels.select("doc_id", "toxic").where(fold() != 0).where("toxic IS NOT NULL")
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    p = known.where("toxic = 1").select("doc_id").distinct().orderBy(key, "doc_id").limit(positives)
    u = docs.select("doc_id").where("doc_id IS NOT NULL").where(fold() != 0).orderBy(key, "doc_id").limit(unlabelled)
    # Both sides have a fixed number of rows, so the broadcast is bounded.
    picked = p.select("doc_id", F.lit(1).alias("side")).unionByName(u.select("doc_id", F.lit(0).alias("side")))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInPandas(_word_sets, "doc_id long, side int, words binary")
    own = F.octet_length("words")
    so_far = F.sum(own).over(Window.partitionBy("side").orderBy(key, "doc_id"))  # some thousand rows
    rows = rows.where(own <= TEXT_BYTES).withColumn("so_far", so_far).where(F.col("so_far") <= FIT_BYTES).select("doc_id", "side", "words").collect()
    rows.sort(key=lambda r: (r.side, r.doc_id))
    sides: tuple[list[bytes], list[bytes]] = ([], [])
    for r in rows:
        sides[r.side].append(bytes(r.words))
    return sides[1], sides[0], (n_toxic / n if n else 0.0)


def _word_sets(batches):
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "side": pdf.side, "words": [b" ".join(sorted(features(t))) for t in pdf.text]})


class Sparse:
    """Rows of feature indices; products by bincount, as no sparse library is at hand."""

    def __init__(self, texts: list[bytes], index: dict[bytes, int]):
        ids = [np.array([index[w] for w in t.split() if w in index], np.int32) for t in texts]
        self.n, self.dims = len(texts), len(index)
        self.cols = np.concatenate([*ids, np.zeros(0, np.int32)])
        self.rows = np.repeat(np.arange(self.n), [len(r) for r in ids])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.dims) if self.n else np.zeros(self.dims)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(p: Sparse, u: Sparse, prior: float, steps: int = 400, rate: float = 1.0, l1: float = 0.00003) -> tuple[np.ndarray, float]:
    """Logistic loss, AdaGrad steps, soft threshold after each of them."""
    w, b = np.zeros(p.dims), -2.0
    seen, seen_b = np.full(p.dims, 1e-4), 1e-4
    for _ in range(steps):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        gp_pos = -_sigmoid(-zp) / p.n  # of l(g) on positives
        gp_neg = _sigmoid(zp) / p.n  # of l(-g) on positives
        gu_neg = _sigmoid(zu) / u.n
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if rest >= 0 else -1.0
        on_p = prior * gp_pos * (sign > 0) - sign * prior * gp_neg
        on_u = sign * gu_neg
        g, gb = p.back(on_p) + u.back(on_u), on_p.sum() + on_u.sum()
        seen += g * g
        seen_b += gb * gb
        step = rate / np.sqrt(seen)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * 0.2 * gb / np.sqrt(seen_b)
    return w, float(b)


class Model:
    """Weights of features that are not zero, and the bias."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        # a beginning is looked up by its bare name, so that name is always known
        self.known = frozenset(weights) | frozenset(w.split(b"#")[0] for w in weights if b":" in w)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights.get(w, 0.0) for w in features(text, self.known)))
        return 1 / (1 + float(np.exp(-max(-40.0, min(40.0, z)))))


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, seed: int = SEED, least: int = 3) -> Model:
    if not positive or not unlabelled:
        return Model({}, -40.0)
    df = Counter(w for t in positive for w in t.split())
    index = {w: i for i, w in enumerate(sorted(w for w, k in df.items() if k >= min(least, len(positive))))}
    order = np.random.default_rng(seed).permutation(len(unlabelled))
    halves = [x for x in (order[::2], order[1::2]) if len(x)]
    p = Sparse(positive, index)
    fits = [fit_nnpu(p, Sparse([unlabelled[i] for i in half], index), min(max(prior, 1e-3), 0.9)) for half in halves]
    w, b = np.mean([x[0] for x in fits], 0), float(np.mean([x[1] for x in fits]))
    return Model({word: float(w[i]) for word, i in index.items() if w[i]}, b)


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    return fit(*training_texts(docs, labels, **bounds))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """A score for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def step(batches):
        m = Model(*shared.value)
        for pdf in batches:
            score = [m.score(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": [not pd.isna(d) and held_out(d) for d in pdf.doc_id], "score": score, "predicted": [int(s >= THRESHOLD) for s in score]}).astype({"held_out": bool, "score": float, "predicted": "int32"})

    return docs.select("doc_id", "text").mapInPandas(step, SCHEMA)


def clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, that are not judged toxic."""
    model = train(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def step(batches):
        m = Model(*shared.value)
        for pdf in batches:
            yield pdf[[m.score(t) < THRESHOLD for t in pdf.text]]

    return like_input(docs, step)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
