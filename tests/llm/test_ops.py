"""The training-data operators against brute force, round trips and odd inputs."""

import gc
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import audio, decontaminate, jaccard, licenses, mixing, pii, preferences, quality, toxicity, url_filter
from strataq.llm.common import held_out

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "n r s t l m d g".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(random.Random(3), 30_000)
    return documents([(1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, long, "b"), (5, "one", "a"), (6, "one", "a"), (6, "one", "a"), (None, "one two", "b"), (7, "é ß İ K", None)])


# --- 1 mixing


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rest * w[s] / open_w > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        full |= set(over)


def test_mixing_targets_and_totals(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), None if i % 17 == 0 else f"s{min(i % 9, 5)}") for i in range(1500)]
    out = mixing.mix(documents(rows), block=64).toPandas()
    assert len(out) == 1500 and (out.taken <= 2 * out["size"]).all()
    sizes = {s: 0 for _, _, s in rows}
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water(sizes)
    for s, part in out.groupby("source", dropna=False):
        s = None if s != s else s
        assert part.source_size.iloc[0] == sizes[s]
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= 200
    again = mixing.mix(documents(rows).repartition(7), block=64).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, s = rng.random(500).tolist(), [float(x) for x in rng.integers(1, 400, 500)]
    before = sum(p), sum(a * b for a, b in zip(p, s))
    live = mixing.flight(p, s, rng)
    assert len(live) <= 2 and sum(0 < x < 1 for x in p) == len(live)
    assert sum(p) == pytest.approx(before[0]) and sum(a * b for a, b in zip(p, s)) == pytest.approx(before[1])


def test_mixing_odd_inputs(documents):
    out = mixing.mix(odd(documents)).toPandas()
    assert len(out) == 9 and out[out["size"] == 0].taken.sum() == 0
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, "a")])).toPandas().taken.tolist() == [0]
    kept = mixing.taken_rows(odd(documents).withColumn("size", F.lit("clash")))
    assert "size" in kept.columns and kept.count() >= 3


def test_taken_rows_share_what_repeated_rows_got(documents):
    rng = random.Random(8)
    rows = [(i % 40 if i % 2 else 1000 + i, prose(rng, 7), f"s{i % 3}") for i in range(240)] + [(None, prose(rng, 4), None)] * 30
    docs = documents(rows).repartition(5).withColumn("mix_size", F.lit("clash")).withColumn("task_of_row", F.lit(1))
    want = {(r.doc_id, r.source, r.size): r.c for r in mixing.copies(mixing.sizes(docs)).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c")).collect() if r.c and r.size}
    for most in (1_000_000, 0):
        got = {}
        for r in mixing.taken_rows(docs, most_rows=most).collect():
            assert r.mix_taken == r.mix_size * r.mix_copies > 0 and r.mix_size == len(r.text.split())
            k = (r.doc_id, r.source, r.mix_size)
            got[k] = got.get(k, 0) + r.mix_copies
        assert got == want
    assert mixing.taken_rows(documents([])).count() == 0


# --- 2 audio


def test_laws_match_their_formulas():
    def mu(b):
        b = ~b & 255
        x = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
        return -x if b & 128 else x

    assert audio.MULAW.tolist() == [mu(b) for b in range(256)]
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0xAA] == 32256 and audio.ALAW[0x2A] == -32256


def slow_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    out = [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            value = max(-32768, min(32767, value - d if nib & 8 else value + d))
            index = max(0, min(88, index + int(audio.MOVES[nib & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_decode_like_one_by_one():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (7, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    assert audio.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", list(audio.CODECS))
def test_stored_audio_round_trips(codec):
    _, data = audio.payload("çà et là" * 31)
    got, chunk = audio.load(audio.store(data, codec))
    assert got == codec and audio.samples_of(codec, chunk) == data and len(data) % 64 == 0


def test_audio_query(documents):
    rows = odd(documents)
    out = audio.digests(rows).toPandas()
    for text, r in zip(rows.toPandas().text, out.itertuples()):
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        # the stored forms, byte by byte, and the feature from plain loops
        codec = ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(padded) % 3]
        blocks = [b"\0\0\x28\0" + padded[i : i + 64] for i in range(0, len(padded), 64)]
        adpcm = codec == "ima_adpcm"
        data = b"".join(blocks) if adpcm else padded
        fmt = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 68 // 129, 68, 4, 2, 129) if adpcm else struct.pack("<HHIIHH", {"mulaw": 7, "alaw": 6}[codec], 1, 8000, 8000, 1, 8)
        wave = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
        wave = b"RIFF" + struct.pack("<I", len(wave)) + wave
        assert (r.codec, r.media_bytes, r.media_sha256) == (codec, len(wave), hashlib.sha256(wave).hexdigest())
        if len(padded) < 1000:
            pcm = [x for b in blocks for x in slow_adpcm(b)] if adpcm else [int((audio.MULAW if codec == "mulaw" else audio.ALAW)[x]) for x in padded]
            wide = [y for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for y in (a, (a + b) >> 1)]
            rms, turns = math.sqrt(sum(x * x for x in wide) / len(wide)), sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
            assert r.feature == f"{len(wide)}|{max(map(abs, wide))}|{rms:.3f}|{turns}|{zlib.crc32(struct.pack(f'<{len(wide)}h', *wide)):08x}" and r.pcm_bytes == 44 + 2 * len(wide)
    same = out[out.n_bytes == 3]
    assert len(same) == 3 and same.feature.nunique() == 1
    assert audio.digests(rows.withColumn("media", F.lit(1)).withColumn("pcm", F.lit("x"))).count() == 9
    assert audio.digests(documents([])).count() == 0
    media = rows.sparkSession.createDataFrame([(1, audio.store(b"ab" * 32, "alaw")), (2, None)], "doc_id long, media binary")
    pcm = audio.resampled(media).toPandas()
    assert len(pcm.pcm[0]) == 44 + 2 * 2 * 64 and pcm.pcm[1] is None


# --- 3 decontamination


def slow_contamination(texts, items, width=13):
    out = []
    for t in texts:
        w = decontaminate.alnum_words(t)
        hit, named = set(), set()
        for item, text in items:  # an item without id hits, but names nothing
            v = decontaminate.alnum_words(text)
            n = min(width, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        named |= {str(item)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        firsts, lasts = sorted(k for k in hit if k - 1 not in hit), sorted(k for k in hit if k + 1 not in hit)
        spans = ";".join(f"{at[a][0]}-{at[b][1]}" for a, b in zip(firsts, lasts))
        out.append((len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w), spans))
    return out


def benchmark_case():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)] + [(90, None), (91, " .. "), (None, prose(rng, 20))]
    texts = []
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 120))]
        if i % 2:
            parts += ["é" * (i % 3), rng.choice([*items[:12], items[-1]])[1].upper().replace(" ", " - "), prose(rng, 30)]
        texts.append("\n".join(parts))
    return items, [*texts, None, "", "..."]


@pytest.mark.parametrize("block_words", [250_000, 60])
def test_decontamination_equals_brute_force(spark, documents, block_words):
    items, texts = benchmark_case()
    docs = documents([*enumerate(texts), (3, texts[3])])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.decontamination(docs, bench, block_words=block_words)
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((i, *x) for i, x in [*enumerate(slow_contamination(texts, items)), (3, slow_contamination([texts[3]], items)[0])])
    bad = {r[0] for r in got if r[5]}
    kept = decontaminate.clean(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad


def test_decontamination_spans_and_empty_benchmark(spark, documents):
    m = decontaminate.Matcher([(1, "Alpha beta gamma")])
    text = "say ALPHA,  beta-Gamma now"
    (a, b), = m.spans(text)
    assert text[a:b] == "ALPHA,  beta-Gamma"
    none = decontaminate.decontamination(odd(documents), spark.createDataFrame([], "item_id long, text string")).toPandas()
    assert len(none) == 9 and not none.contaminated.any() and none.n_words.max() == 30_000


# --- 4 quality, 7 toxicity


def test_quality_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    idx, val = np.array([1, 5, 9, 22]), rng.normal(size=4)
    pairs = sum(m.v[i] @ m.v[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(idx, val), 2))
    assert m.score(idx, val) == pytest.approx(1 / (1 + np.exp(-(0.3 + m.w[idx] @ val + pairs))))


def labelled(spark, documents, bad, column):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        text = prose(rng, rng.randint(20, 80))
        wrong = i % 5 == 0
        rows.append((i, bad(rng, text) if wrong else text, "s"))
        labels.append((i, int(wrong) if column == "toxic" else int(not wrong)))
    return documents(rows), spark.createDataFrame(labels, f"doc_id long, {column} int"), {i for i, y in labels if y}


def test_quality_held_out_accuracy(spark, documents):
    docs, labels, good = labelled(spark, documents, lambda rng, t: " | ".join(w.upper() + "!!" for w in t.split()), "quality")
    out = quality.quality(docs, quality.train(docs, labels)).toPandas()
    assert (out.held_out == [held_out(i) for i in out.doc_id]).all()
    test = out[out.held_out]
    assert ((test.predicted == 1) == test.doc_id.isin(good)).mean() > 0.97
    assert quality.quality(odd(documents), quality.train(docs, labels.limit(0))).toPandas().score.between(0, 1).all()
    machine = quality.train(docs, labels)
    strange = quality.quality(odd(documents).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(1)), machine).toPandas()
    assert len(strange) == 9 and strange.score.between(0, 1).all() and strange[strange.doc_id == 6].score.nunique() == 1
    assert quality.quality(documents([]), machine).count() == 0
    for r, (text, n) in zip(out.sort_values("doc_id").itertuples(), [(x.text, x.n_chars) for x in docs.orderBy("doc_id").collect()][:30]):  # the pairs one by one
        idx, val = quality.inputs(text, n)
        z = machine.w0 + sum(machine.w[i] * x for i, x in zip(idx, val))
        g = (machine.v[idx] @ machine.v[idx].T) * np.outer(val, val)
        z += (g.sum() - np.trace(g)) / 2
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_held_out_accuracy(spark, documents):
    def bad(rng, t):
        w = t.split()
        for _ in range(2):
            w.insert(rng.randrange(len(w)), rng.choice(["grubbel", "snarkid", "pelfous"]))
        return " ".join(w)

    docs, labels, toxic = labelled(spark, documents, bad, "toxic")
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, model).toPandas()
    test = out[out.held_out]
    assert ((test.predicted == 1) == test.doc_id.isin(toxic)).mean() > 0.97
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 720) <= 10
    strange = toxicity.toxicity(odd(documents), model).toPandas()
    assert len(strange) == 9 and strange.score.between(0, 1).all() and not strange.predicted.any()
    assert toxicity.toxicity(documents([]), model).count() == 0 and toxicity.clean(documents([]), labels).count() == 0
    clash = toxicity.toxicity(docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9)), toxicity.train(docs.withColumn("toxic", F.lit(9)), labels.withColumn("text", F.lit("x")))).toPandas()
    assert clash.sort_values("doc_id").score.tolist() == out.sort_values("doc_id").score.tolist()
    for r, text in zip(out.sort_values("doc_id").itertuples(), [x.text for x in docs.orderBy("doc_id").collect()][:40]):  # by the plain sum of weights
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert toxicity.toxicity(odd(documents), toxicity.train(docs, labels.limit(0))).toPandas().score.max() < 0.5


# --- 5 preferences


def test_preferences_prefix_masks_and_pairs(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "good")]
    b = [*a[:3], ("assistant", "bad")]
    assert preferences.split_pair(a, b) == 3 and preferences.split_pair(a, a) == 4 and preferences.split_pair(a, a[:2]) == 2
    text, spans = preferences.masked(a[3:])
    assert [text[x:y] for x, y in spans] == ["good<|end|>\n"]
    rows = [(c, t, r, x) for c, turns in ((1, a), (2, b), (3, [("user", "alone")])) for t, (r, x) in enumerate(turns)]
    rows += [(1, 0, "user", "hi"), (4, 0, None, None), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.chosen_id: r for r in preferences.format_pairs(preferences.pair_up(preferences.conversations(table))).collect()}
    assert set(out) == {1, 3, 4} and out[1].rejected_id == 2 and out[1].n_common == 3
    assert out[1].prompt == preferences.render(a[:3]) and "bad" in out[1].rejected and out[3].rejected is None
    assert out[3].prompt == "" and out[3].chosen == preferences.render([("user", "alone")])
    assert preferences.pair_up(preferences.conversations(table.limit(0))).count() == 0


def slow_pairs(rows, bin_size=64):
    """Pairs of the query by plain rules: prefix, masks and choice, given which ids are paired."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, set()).add((t, r or "user", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0], y[1].encode(), y[2].encode()))] for c, v in convs.items()}


def test_preferences_query_equals_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for c in range(90):
        turns = [("user", rng.choice(["hi", "hello", "é" * 3])), ("assistant", rng.choice(["yes", "no", ""])), ("user", rng.choice(["more", None])), ("assistant", "w" * rng.choice([1, 1, 5, 20_000]))][: rng.randint(1, 4)]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)] * rng.choice([1, 1, 2])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", F.lit(1)).withColumn("n", F.lit("x"))
    convs = slow_pairs(rows)
    out = preferences.format_pairs(preferences.pair_up(preferences.conversations(table), bin_size=8)).collect()
    assert sorted(x for r in out for x in (r.chosen_id, r.rejected_id) if x is not None) == sorted(convs)
    voice = lambda c: sum(len(x) for r, x in convs[c] if r == "assistant")
    for r in out:
        c, d = convs[r.chosen_id], convs.get(r.rejected_id)
        n = 0
        while d is not None and n < min(len(c), len(d)) and c[n] == d[n]:
            n += 1
        assert (r.n_common, r.prompt) == (n, preferences.render(c[:n])) and r.prompt + r.chosen == preferences.render(c)
        assert [r.chosen[a:b] for a, b in r.chosen_mask] == [x + "<|end|>\n" for role, x in c[n:] if role == "assistant"]
        if d is None:
            assert r.rejected is None and r.rejected_mask is None
            continue
        assert c[0] == d[0] and r.prompt + r.rejected == preferences.render(d)
        assert [r.rejected[a:b] for a, b in r.rejected_mask] == [x + "<|end|>\n" for role, x in d[n:] if role == "assistant"]
        assert (-voice(r.chosen_id), r.chosen_id) < (-voice(r.rejected_id), r.rejected_id)  # equal voices: the lower id


def test_preferences_split_a_hot_first_turn(spark):
    rows = [(c, t, r, f"{t}" if t == 0 else f"{t}.{c}") for c in range(300) for t, r in ((0, "user"), (1, "assistant"))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = preferences.pair_up(preferences.conversations(table), bin_size=16).toPandas()
    ids = [*out.chosen_id, *out.rejected_id.dropna()]
    assert sorted(ids) == list(range(300)) and out.rejected_id.notna().sum() > 120


# --- 6 licenses


def test_licenses(documents):
    apache = "x y Licensed under the APACHE License, Version 2.0. mit license"
    docs = documents([(1, apache), (2, None), (3, ""), (4, "general public license general public license"), (5, "Licensed under CC BY-NC 4.0."), (6, "apachelicense mit-License"), (7, "licensed under cc by hand")])
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].labels, out[1].score) == (2, 5, 10, "apache,mit", "apache,mit", 1.0)
    assert (out[2].n_words, out[2].n_base, out[2].first_word, out[2].labels, out[2].score) == (0, 0, None, "", 0.0)
    assert (out[4].n_base, out[4].first_word, out[4].last_word, out[4].base_labels) == (2, 0, 3, "gpl")
    assert (out[5].base_labels, out[5].labels, out[5].score) == ("", "cc-by-nc", 1.0)
    assert out[6].n_base == 1 and out[6].n_words == 3 and out[7].labels == ""
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and licenses.scan(docs.limit(0)).count() == 0


def test_licenses_odd_inputs(documents):
    docs = odd(documents).withColumn("labels", F.lit(1)).withColumn("w", F.lit("x")).withColumn("l", F.lit(2))
    out = licenses.scan(docs).collect()
    assert len(out) == 9 and all((r.labels, r.n_base, r.score) == ("", 0, 0.0) for r in out) and max(r.n_words for r in out) == 30_000
    long = prose(random.Random(2), 20_000) + " released under the MIT license " + prose(random.Random(3), 20_000)
    out = licenses.scan(documents([(1, long), (1, long), (2, long + " under the MIT license")])).collect()
    assert [(r.doc_id, r.n_base, r.first_word, r.labels, r.score) for r in sorted(out, key=lambda r: r.doc_id)] == [(1, 1, 20_003, "mit", 1.0)] * 2 + [(2, 2, 20_003, "mit", 1.0)]


def plain_licenses(text):
    """Labels and score by trying every template at every place."""
    w, labels, best = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")), set(), 0.0
    labels |= {label for i in range(len(w)) for phrase, label in licenses.BASE.items() if w[i : i + len(phrase.split())] == phrase.split()}
    for name, (template, keys) in licenses.TEMPLATES.items():
        t = template.split()
        for o in range(-len(t), len(w)):
            s = sum(0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(t)) / len(t)
            inside = f" {' '.join(w[max(o, 0) : max(o, 0) + len(t)])} "
            if s >= licenses.LEAST and all(f" {k} " in inside for k in keys):
                labels.add(licenses.label_of(name))
                best = max(best, s)
    return ",".join(sorted(labels)), best


def test_licenses_in_a_file_with_many_index_words(documents):
    """Ordinary words and other notices do not take a template's votes away."""
    notice = {n: t for n, (t, _) in licenses.TEMPLATES.items()}
    texts = ["the terms of this work and its purpose are subject to review. Licensed under CC BY-NC 4.0", ". ".join(notice[n] for n in ("mit", "gpl", "apache")), " . ".join(notice.values()), " x ".join(reversed(notice.values()))]
    rnd = random.Random(6)
    for t in notice.values():  # as many words changed as a match may miss, or one more
        for _ in range(4):
            w = t.split()
            for k in rnd.sample(range(len(w)), len(w) // 4 + rnd.randint(0, 1)):
                w[k] = rnd.choice(["zzz", "work", "a", "terms"])
            texts.append("work terms subject purpose " * rnd.randint(0, 1) + " ".join(w[rnd.randint(0, 1) :]))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    every = set(map(licenses.label_of, notice))
    assert got[0] == ("cc-by-nc", 1.0) and set(got[2][0].split(",")) == set(got[3][0].split(",")) == every and len(notice) > 36
    assert not licenses.STOP.intersection(licenses.anchors())
    assert got == {i: plain_licenses(t) for i, t in enumerate(texts)}


# --- 8 urls


def slow_rule(host, path, rules):
    fits = [(r.partition("/")[0].count("."), len(r) - r.index("/"), r, v) for r, v in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    return max(fits)[2:] if fits else None


def test_url_filter(spark):
    trie = url_filter.Trie(url_filter.RULES)
    rng = random.Random(6)
    for _ in range(400):
        host = ".".join(rng.choice(["a", "example", "com", "net", "org", ""]) for _ in range(rng.randint(1, 4)))
        path = rng.choice(["", "/", "/en", "/en/", "/en/1", "/de/x", "/fr//", "//en/"])
        assert trie.match(host, path) == slow_rule(host, path, url_filter.RULES)
    rules = [("a.b/x", "block"), ("a.b/xy/", "allow"), ("b/", "allow"), ("a.b/xy/q", "block")]
    trie = url_filter.Trie(rules)
    for path in ("/x", "/xy", "/xy/", "/xy/q1", "/z", ""):
        assert trie.match("c.a.b", path) == slow_rule("c.a.b", path, rules)
    urls = ["HTTP://Blog.Example.NET/En?q#f", "https://example.net/en/1", None, "no scheme", "x://ORG/fr/#a", "x://y.org?fr/"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    out = url_filter.url_filter(table).orderBy("page_id").toPandas()
    assert out.host.tolist() == ["blog.example.net", "example.net", "", "", "org", "y.org"]
    assert out.verdict.tolist() == ["block", "allow", "allow", "allow", "allow", "allow"]
    assert [r if isinstance(r, str) else None for r in out["rule"]] == ["net/", "example.net/en/", None, None, "org/fr/", None]


def test_url_filter_in_blocks_and_odd_inputs(spark):
    rng = random.Random(16)
    hosts = ["a.b", "x.a.b", "b", "c.d", "y.c.d"]
    rules = list({(f"{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/', 'p/q', 'q'])}", rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"http://{rng.choice(['', 'z.'])}{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q/r', 'q', 'P'])}" for _ in range(80)] + [None, "", "x://" + "l" * 50_000 + ".a.b/p" + "/q" * 30_000]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string").withColumn("path", F.lit(3))
    whole, parts = (sorted(map(tuple, url_filter.url_filter(pages, rules, "none", most).collect()), key=str) for most in (500, 7))
    assert whole == parts and len(whole) == 84 and {x[4] for x in whole} == {"allow", "block", "none"}
    assert url_filter.url_filter(pages.limit(0)).count() == 0 and url_filter.url_filter(pages.limit(0), rules, most=7).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, []).collect()} == {"allow"}


# --- 9 PII


@pytest.mark.parametrize("text", ["(Dr. Smith)", "he said 'Anna Schmidt' today", 'said "Anna Schmidt" today', '{"name":"Maria Lopez"}', "contact:Maria Lopez", "author -Peter Brown", "x\u2014Mrs Jones", "a,John Miller", "[Herr Braun]"])
def test_pii_finds_names_after_any_sign(text):
    """As many places as the patterns match, whatever stands before the name."""
    want = {m.span(g) for pattern in (pii.TITLED, pii.GIVEN) for m in pattern.finditer(text) for g in "ab" if m[g] and m[g][0].isupper()}
    assert want and {x[:2] for x in pii.find(text)} == want
    new = pii.replace(text, pii.Surrogates(b"k"))[0]
    assert all(new[a:b] != text[a:b] for a, b in want)


def test_pii_is_distinct_coreferent_and_of_one_format(documents):
    made = pii.Surrogates(b"k")
    cards = [f"{4000000000000000 + i}" for i in range(300)]
    new = [made.make("card", c) for c in cards]
    assert len(set(new)) == 300 and all(pii.luhn(a) == pii.luhn(b) for a, b in zip(cards, new))
    assert len({made.make("given", n) for n in pii.NAMES["latin", "f"]}) == len(pii.NAMES["latin", "f"])
    text = "Mrs Anna Weiß (Anna.W@Mail.example.com, +1 (017) 555-7713) wrote; anna.w@mail.example.com, +10175557713, 10.0.0.1, token = \"ab12cd34ab12\""
    out, log, _ = pii.replace(text, made)
    by = {}
    for kind, a, b in log:
        by.setdefault((kind, pii.canonical(kind, a)), set()).add(pii.canonical(kind, b))
    assert all(len(v) == 1 for v in by.values()) and len(by) == 6
    assert all(a not in out for kind, a, _ in log if kind != "given") and out.startswith("Mrs ")
    name = out.split()[1]
    assert name in pii.NAMES["latin", "f"] and out == pii.replace(text, pii.Surrogates(b"k"))[0] != pii.replace(text, pii.Surrogates(b"j"))[0]
    plain = prose(random.Random(1), 500)
    assert pii.replace(plain, made)[0] == plain and pii.replace(None, made)[0] is None
    rows = pii.pseudonyms(odd(documents)).toPandas()
    assert len(rows) == 9 and rows.n_entities.sum() == 0
    docs = documents([(1, "call +1 (017) 555-7713"), (2, None), (3, "fine")]).withColumn("kinds", F.lit(1))
    kept = pii.clean(docs).orderBy("doc_id").collect()
    assert kept[0].text != "call +1 (017) 555-7713" and kept[1].text is None and kept[2].text == "fine" and len(kept[0].text) == kept[0].n_chars


def test_cipher_is_a_permutation():
    c = pii.Cipher(b"x")
    for n in (1, 2, 7, 100, 1000):
        assert sorted(c.permute(i, n, b"t") for i in range(n)) == list(range(n))
        assert all(c.permute(c.permute(i, n, b"t"), n, b"t", back=True) == i for i in range(n))
        moved = [c.step(i, n, b"t") for i in range(n)]
        assert sorted(moved) == list(range(n)) and (n == 1 or all(a != i for i, a in enumerate(moved)))


def test_pii_stays_distinct_when_a_whole_list_of_names_is_used():
    """Of every subset of a list, by brute force: no two people become one, none keeps the name."""
    made, rng = pii.Surrogates(b"k"), random.Random(5)
    for names in pii.NAMES.values():
        for k in (len(names), len(names) - 1, len(names) // 2):
            some = rng.sample(names, k)
            text = "; ".join(f"{n} Nowak" for n in some)
            out, log, clashes = pii.replace(text, made)
            new = [x for kind, _, x in log if kind == "given"]
            assert clashes == 0 and len(set(new)) == k and set(new) <= set(names) and all(a != b for kind, a, b in log)
    one, two = (pii.replace(t, made)[1] for t in ("Dr. Anna Kern and Maria Kern", "Mr. Paul Kern, Anna Kern, Helena Kern"))
    assert dict((a, b) for _, a, b in one)["Anna"] == dict((a, b) for _, a, b in two)["Anna"]
    many = [made.make("secret", f"{x:08x}") for x in range(400)] + [made.make("secret", f"zz{x:06d}") for x in range(400)]
    assert len(set(many)) == 800
    mails = [f"u{i}@{d}" for i in range(50) for d in ("mail.example.com", "example.com", "shop.com", "a.example", "b.test")]
    assert len({made.make("email", m) for m in mails}) == len(mails)


def test_pii_finds_names_outside_the_lists():
    text = 'Dear Ilse, "author": "Zora Quandt", bo.stern@corp.de is Bo Stern. Mrs Anna Maria Lopez. Later Quandt, Lopez and Stern met.'
    out, log, _ = pii.replace(text, pii.Surrogates(b"k"))
    assert not any(re.search(rf"\b{n}\b", out) for n in ("Ilse", "Zora", "Quandt", "Stern", "Lopez", "Bo"))
    of = {}
    for kind, a, b in log:
        assert of.setdefault((kind, a), b) == b and a != b
    long = "x" * 50_000 + "@ " + " ".join(f"a{i}@b.example.com" for i in range(3000))
    assert len(pii.find(long)) == 3000


# --- 10 n-gram Jaccard join


def slow_components(rows, percent=85, n=4):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def copies_case(n=260, seed=11):
    rng = random.Random(seed)
    bases = [prose(rng, rng.choice([3, 5, 40, 90])) for _ in range(12)]
    shared = prose(rng, 50)
    rows = []
    for i in range(n):
        w = rng.choice(bases).split() if i % 3 else prose(rng, rng.randint(1, 80)).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((1000 - i, " ".join(w) + (" " + shared if i % 7 == 0 else "")))
    return rows


@pytest.mark.parametrize("options", [{}, {"unit": 600, "common": 0}, {"unit": 300, "common": 50}])
def test_jaccard_equals_brute_force(documents, options):
    rows = copies_case()
    out = jaccard.jaccard_components(documents(rows).repartition(3), **options)
    assert sorted(tuple(r) for r in out.collect()) == slow_components(rows)


def test_jaccard_deals_out_hot_ngrams(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 16)
    monkeypatch.setattr(jaccard, "PART", 4)
    rows = copies_case(200, 5)
    out = jaccard.jaccard_components(documents(rows).coalesce(1), unit=500)
    assert sorted(tuple(r) for r in out.collect()) == slow_components(rows)


@pytest.mark.parametrize("by_words", [True, False])
def test_jaccard_takes_clusters_of_chance_apart(documents, monkeypatch, by_words):
    rng = random.Random(8)
    phrases = [f"the of and in{i} to a" for i in range(10)]
    rows = []
    for i in range(240):
        own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(36, 40)))
        rows.append((i, f"{phrases[i % 10]} {own} {phrases[(i + i // 10) % 10]}"))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 240, 9)]
    weights, links, counts = [], jaccard.unit_links, jaccard.common_ngrams
    monkeypatch.setattr(jaccard, "unit_links", lambda nodes, *a: weights.extend(r[0] for r in nodes.groupBy("cluster").agg(F.sum("n_shingles")).select("sum(n_shingles)").collect()) or links(nodes, *a))
    if not by_words:  # the first order knows nothing: chains through the phrases connect the table
        monkeypatch.setattr(jaccard, "common_ngrams", lambda *a: tuple(x[:0] for x in counts(*a)))
    out = jaccard.jaccard_components(documents(rows).repartition(3), common=0 if by_words else 5000, unit=400)
    assert sorted(tuple(r) for r in out.collect()) == slow_components(rows)
    assert len(weights) >= 27 and max(weights) <= 400


def test_jaccard_is_exact_where_small_groups_are_chained(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    rows = copies_case(200, 9)
    out = jaccard.jaccard_components(documents(rows).repartition(3), unit=300)
    assert sorted(tuple(r) for r in out.collect()) == slow_components(rows)


def test_jaccard_odd_inputs(documents):
    out = jaccard.jaccard_components(odd(documents)).toPandas()
    got = {(None if d != d else int(d), n): c for d, n, c in zip(out.doc_id, out.n_shingles, out.component_id)}
    assert len(out) == 9 and got[5, 1] == 5 and got[6, 1] == 5 and got[1, 0] == 1 and got[2, 0] == 2 and got[None, 1] != got[None, 1]
    assert jaccard.jaccard_components(documents([])).count() == 0
    kept = jaccard.clean(odd(documents).withColumn("node", F.lit(1)))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7] and "node" in kept.columns


def test_jaccard_repeated_ids_with_other_texts(documents):
    """A link holds for the row's own text, whatever the order of rows; see the module for what stays."""
    rng = random.Random(12)
    a, b = (" ".join(rng.sample(WORDS, 60)) for _ in range(2))
    for rows in ([(1, a), (1, b), (2, b + " ba"), (3, a + " ba")], [(1, b), (1, a), (2, b + " ba"), (3, a + " ba")]):
        out = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(documents(rows)).collect()}
        assert out == {(1, 57): 1, (2, 58): 1, (3, 58): 1}
    c, d = (" ".join(rng.sample(WORDS, 60)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (2, b + " ba"), (5, a + " ba"), (5, c), (5, None), (7, d), (7, d), (8, " "), (8, "")]
    kept = [(r.doc_id, r.text) for r in jaccard.clean(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (5, c), (5, None), (7, d), (8, " "), (8, "")], key=str)


def test_jaccard_brings_sketches_to_slices_and_leaves_no_shuffle_files(spark, documents, monkeypatch):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before, least, links, given = files(), [], jaccard.unit_links, []

    def counted(*a):
        until = time.time() + 10
        while files() > before and time.time() < until:
            time.sleep(0.2)
        least.append(files())
        return links(*a)

    put = jaccard.Store.put
    monkeypatch.setattr(jaccard.Store, "put", lambda self, df: given.append(df.columns) or put(self, df))
    monkeypatch.setattr(jaccard, "unit_links", counted)
    monkeypatch.setattr(jaccard, "SLICE", 100, raising=False)
    rows = copies_case(200, 4)
    out = jaccard.jaccard_components(documents(rows).repartition(3), unit=600)
    assert least[0] <= before
    assert given.count(["a", "b"]) > 2 and sorted(tuple(r) for r in out.collect()) == slow_components(rows)


def test_jaccard_clean_moves_no_text_where_most_rows_go(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "GONE", 4)
    rng = random.Random(6)
    texts = [prose(rng, 30) for _ in range(2)]
    rows = [(i, texts[i % 2]) for i in range(2, 14)] + [(20, ""), (None, texts[0]), (None, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.clean(documents(rows))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(2, texts[0]), (3, texts[1]), (20, ""), (None, texts[0]), (None, None)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_jaccard_a_large_group_of_near_copies(documents):
    """More than a unit holds: pivots link most, the second round the rest."""
    rng = random.Random(2)
    base = [prose(rng, 80) for _ in range(3)]
    rows = []
    for i in range(330):
        w = (base[i % 3] if i % 11 else prose(rng, 80)).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w[: rng.randint(70, 80)])))
    for unit in (500, 2000):
        out = jaccard.jaccard_components(documents(rows).repartition(5), unit=unit)
        assert sorted(tuple(r) for r in out.collect()) == slow_components(rows)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for n in (20, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(0.08 * len(a)) :], rng.integers(0, 2**63, int(0.07 * n), dtype=np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b))
    assert not jaccard.may_link(jaccard.sketch(a), jaccard.sketch(a ^ np.uint64(0xFFFFFFFFFF0000)), len(a), len(a))


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**40, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < r, rng.integers(0, 2**40, 200, dtype=np.uint64), base))[: rng.integers(150, 200)] for r in rng.choice([0.01, 0.04, 0.09], 60)]
    root = jaccard.join_unit(sets, [2] * 60)
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(60), 2):
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
            parent[find(i)] = find(j)
    assert all((root[i] == root[j]) == (find(i) == find(j)) for i, j in itertools.combinations(range(60), 2))
