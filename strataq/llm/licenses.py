"""License scans by a positional rare-token index, in Spark SQL only.

Base: places where the words of a phrase stand next to each other (``mit
license``, ``apache license``, ``general public license``).

Method: inverse document frequency is counted over a corpus of licence notices.  Of every
notice the words of highest IDF that are no function words are anchors, one more of them
than words that a match may miss, so that every match has an anchor in its place.  Every
occurrence of an anchor votes for the place in the file at which the notice would begin
(its own position less the posting's), which intersects the postings by relative
position.  A notice is found at a place if at least ``LEAST`` of its words stand where they
should and all its mandatory key phrases lie inside.  The score is the best share of words.

The index is a literal of fixed size inside the expression.  Only texts that have
every word of the key phrases of some notice, as substrings, are split; words are an array
inside the row: there is no shuffle, no Python, and a file of any length is one row.

Cases: null and wordless texts have no words, null places, empty labels and
score 0; a very long text is scanned whole; of several places of a notice, and of notices
with one label, the best share counts; repeated rows are judged one by one; an empty table
gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame

from .common import LOWER, UPPER, table

# Words of public licence notices as they stand in files, and key phrases that must all be there.
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0", ["apache license"]),
    "apache-grant": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license", "except in compliance with the license"]),
    "apache-terms": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["agreed to in writing", "as is basis"]),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["the software is provided as is", "noninfringement"]),
    "gpl": ("this work is licensed under the gnu general public license version 3", ["general public license"]),
    "gpl-grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["in the hope that it will be useful", "general public license"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    "agpl": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    "fdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["free documentation license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "specific prior written permission"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    "isc-warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["author disclaims all warranties"]),
    "mpl": ("this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at", ["eclipse public license", "accompanying materials"]),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["possible under law", "neighboring rights"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc-by-sa-text": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-nc-text": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    "cc-by-nd": ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["attribution noderivatives"]),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["alter it and redistribute it freely"]),
    "boost": ("distributed under the boost software license version 1 0 see accompanying file or copy at", ["boost software license"]),
    "artistic": ("this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ["artistic license"]),
    "ofl": ("this font software is licensed under the sil open font license version 1 1", ["open font license"]),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["verbatim or modified copies"]),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["without a written agreement"]),
    "psf": ("this license agreement is between the python software foundation and the individual or organization accessing and otherwise using this software", ["python software foundation", "accessing and otherwise using"]),
    "eupl": ("licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ["european commission", "subsequent versions of the eupl"]),
    "ms-pl": ("this license governs use of the accompanying software if you use the software you accept this license", ["license governs use of the accompanying software"]),
    "proprietary": ("all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ["unauthorized copying", "proprietary and confidential"]),
}
#: Function words, never anchors.
STOP = frozenset("a all an and any are as at be but by for from has if in is it its may nor not of on or other so that the their then there they this to under use used was which will with you your".split())
PARTS = ("-text", "-grant", "-terms", "-warranty", "-source", "-endorse")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
LEAST = 0.75
#: More than there are notices, and words of one.
SPAN = 64


def label_of(name: str) -> str:
    for part in PARTS:
        name = name.removesuffix(part)
    return name


def idf() -> dict[str, int]:
    """1000 * ln(notices / notices with the word), rounded."""
    df = Counter(w for text, _ in TEMPLATES.values() for w in set(text.split()))
    return {w: round(1000 * math.log(len(TEMPLATES) / k)) for w, k in df.items()}


def anchors() -> dict[str, list[tuple[int, int]]]:
    """Postings (notice, position) of the anchor words."""
    rank, out = idf(), {}
    for t, (text, _) in enumerate(TEMPLATES.values()):
        words = text.split()
        missing = len(words) - math.ceil(LEAST * len(words))
        rare = sorted((p for p, w in enumerate(words) if w not in STOP), key=lambda p: (-rank[words[p]], -len(words[p]), p))
        assert len(rare) > missing and len(words) < SPAN
        for p in rare[: missing + 1]:
            out.setdefault(words[p], []).append((t, p))
    return out


def _sql_array(words, kind: str = "string") -> str:
    return "array(" + ", ".join(f"'{w}'" if kind == "string" else str(w) for w in words) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """Base places and the method's labels for every row of ``docs`` (doc_id, text)."""
    names = list(TEMPLATES)
    index = sorted(anchors().items())
    vocab = _sql_array([w for w, _ in index])
    # postings of each anchor, as (template, position) pairs
    posts = "array(" + ", ".join("array(" + ", ".join(f"named_struct('t', {t}, 'p', {p})" for t, p in found) + ")" for _, found in index) + ")"
    texts = "array(" + ", ".join(_sql_array(TEMPLATES[n][0].split()) for n in names) + ")"
    keys = "array(" + ", ".join(_sql_array([f" {k} " for k in TEMPLATES[n][1]]) for n in names) + ")"
    labels = _sql_array([label_of(n) for n in names])
    word, any_case = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    # a label needs its key phrases, and a phrase needs each of its words somewhere
    rank = idf()
    needed = {frozenset(w for k in keys for w in k.split()) for _, keys in TEMPLATES.values()} | {frozenset(k.split()) for k in BASE}
    needed = {x for x in needed if not any(y < x for y in needed)}  # the weaker condition covers it
    maybe = " OR ".join("(" + " AND ".join(f"contains(l, '{w}')" for w in sorted(x, key=lambda w: (-len(w), -rank[w], w))) + ")" for x in sorted(needed, key=sorted))
    steps = [
        # words only where a phrase may stand; elsewhere their number is enough
        ["doc_id", "coalesce(text, '') AS text", "lower(coalesce(text, '')) AS l"],
        ["doc_id", "text", f"({maybe}) AS base"],
        ["doc_id", "base", f"CASE WHEN base THEN regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '({word})', 1) END AS w", f"CASE WHEN NOT base THEN regexp_count(text, '{any_case}') END AS n"],
        ["doc_id", "w", "CAST(coalesce(n, size(w)) AS bigint) AS n_words",
         "CASE WHEN size(w) > 0 THEN flatten(transform(sequence(0, size(w) - 1), i -> CASE "
         "WHEN get(w, i) = 'mit' AND get(w, i + 1) = 'license' THEN array(named_struct('at', i, 'label', 'mit')) "
         "WHEN get(w, i) = 'apache' AND get(w, i + 1) = 'license' THEN array(named_struct('at', i, 'label', 'apache')) "
         "WHEN get(w, i) = 'general' AND get(w, i + 1) = 'public' AND get(w, i + 2) = 'license' THEN array(named_struct('at', i, 'label', 'gpl')) "
         "ELSE CAST(array() AS array<struct<at: int, label: string>>) END)) END AS b"],
        # occurrences of anchors, then their votes as numbers, of which the different ones are found by hash
        ["doc_id", "w", "n_words", "b",
         f"CASE WHEN size(w) > 0 THEN filter(transform(w, (x, i) -> named_struct('i', i, 'v', array_position({vocab}, x))), x -> x.v > 0) END AS hits"],
        ["doc_id", "w", "n_words", "b",
         f"transform(array_distinct(flatten(transform(hits, h -> transform(get({posts}, CAST(h.v AS int) - 1), q -> CAST(h.i - q.p + {SPAN} AS bigint) * {SPAN} + q.t)))), "
         f"v -> named_struct('t', CAST(v % {SPAN} AS int), 'o', CAST(v DIV {SPAN} AS int) - {SPAN})) AS votes"],
        ["doc_id", "w", "n_words", "b",
         f"transform(votes, q -> named_struct('t', q.t, 'o', q.o, 's', "
         f"size(filter(sequence(0, size(get({texts}, q.t)) - 1), k -> q.o + k >= 0 AND coalesce(get(w, q.o + k), '') = get(get({texts}, q.t), k))) / CAST(size(get({texts}, q.t)) AS double))) AS scored"],
        ["doc_id", "n_words", "b",
         f"filter(scored, q -> q.s >= {LEAST} AND forall(get({keys}, q.t), k -> contains(concat(' ', array_join(slice(w, greatest(q.o, 0) + 1, size(get({texts}, q.t))), ' '), ' '), k))) AS found"],
        ["doc_id", "n_words", "CAST(coalesce(size(b), 0) AS bigint) AS n_base",
         "CAST(array_min(transform(b, x -> x.at)) AS bigint) AS first_word", "CAST(array_max(transform(b, x -> x.at)) AS bigint) AS last_word",
         "coalesce(array_join(array_sort(array_distinct(transform(b, x -> x.label))), ','), '') AS base_labels",
         f"array_join(array_sort(array_distinct(concat(coalesce(transform(b, x -> x.label), CAST(array() AS array<string>)), coalesce(transform(found, q -> get({labels}, q.t)), CAST(array() AS array<string>))))), ',') AS labels",
         "coalesce(array_max(transform(found, q -> q.s)), 0.0D) AS score"],
    ]
    out = docs.select("doc_id", "text")
    for step in steps:
        out = out.selectExpr(*step)
    return out.selectExpr("doc_id", "n_words", "greatest(n_base, 0L) AS n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Brute force on exploded words: every notice at every place where any word of it would fit."""
    words = ", ".join(f"({t}, {p}, '{w}')" for t, (text, _) in enumerate(TEMPLATES.values()) for p, w in enumerate(text.split()))
    keys = ", ".join(f"({t}, '{label_of(n)}', {len(text.split())}, [{', '.join(f"' {k} '" for k in found)}])" for t, (n, (text, found)) in enumerate(TEMPLATES.items()))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT rid, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM docs WHERE len(w) > 0),
nxt AS (SELECT rid, i, x, lead(x) OVER (PARTITION BY rid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS z FROM words),
base AS (
  SELECT rid, i, CASE WHEN x = 'general' THEN 'gpl' ELSE x END AS label FROM nxt
  WHERE (x = 'mit' AND y = 'license') OR (x = 'apache' AND y = 'license') OR (x = 'general' AND y = 'public' AND z = 'license')),
notice(t, p, x) AS (VALUES {words}),
keys(t, label, n, k) AS (VALUES {keys}),
fits AS (SELECT w.rid, q.t, w.i - q.p AS o, count(*) AS c FROM words w JOIN notice q ON q.x = w.x GROUP BY ALL HAVING c > 2),
found AS (
  SELECT DISTINCT f.rid, k.label, f.c / CAST(k.n AS DOUBLE) AS s FROM fits f JOIN keys k ON k.t = f.t JOIN docs d ON d.rid = f.rid
  WHERE f.c >= {LEAST} * k.n AND len(list_filter(k.k, lambda y: NOT contains(' ' || array_to_string(d.w[greatest(f.o, 0) + 1 : greatest(f.o, 0) + k.n], ' ') || ' ', y))) = 0),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM found) GROUP BY rid),
f AS (SELECT rid, max(s) AS score FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM docs LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN f USING (rid)
"""


OP6_SQL = _oracle()
