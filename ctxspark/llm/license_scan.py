"""Licence scans of paragraphs, DataFrame functions only.

A multinomial logistic regression with an L1 penalty over word 1- and 2-grams is trained on the driver
from the statements below (notices of each family, and unrelated or other legal prose as class `unknown`).
A paragraph without any anchor (a 1- or 2-gram with a word of MARKERS to which the training gave weight and
that the other prose doesn't hold) is unknown by definition; others are scored by joining their n-grams
with the sparse weights. Probabilities are calibrated on notices that the fit has not seen. A family is
reported if its probability reaches THRESHOLD and enough of one of the family's notices is in the
paragraph. Each line is scanned as a paragraph of its own first; then the lines left between lines with a
notice and lines without words are scanned together, for notices that are wrapped. Only texts that hold a
marker leave the scan, so that little but they is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles

THRESHOLD = 0.5
#: Share of a notice's distinct words that a paragraph must hold to confirm the family.
CONFIRM = 0.6
#: Up to so many documents' notice lines are broadcast; above, it is a shuffled join.
BROADCAST_KEYS = 500_000
STEPS, RATE, L1, FOLDS = 300, 0.5, 2e-4, 4
UNKNOWN = "unknown"

# Words without which nothing is a licence notice.
MARKERS = ["agpl", "apache", "boost", "confidential", "copyright", "eupl", "gpl", "gplv2", "gplv3", "lgpl", "licence", "licensed", "license", "licenses", "mozilla", "permission", "permitted", "proprietary", "public domain", "redistribute", "redistribution", "rights reserved", "spdx", "unencumbered", "unlicense", "warranty", "wtfpl"]
# Usual notices of licence families, in our own selection.
NOTICES: dict[str, list[str]] = {
    "mit": ["Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "Apache License Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl": ["Licensed under the GNU General Public License v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU GENERAL PUBLIC LICENSE Version 3", "GNU GENERAL PUBLIC LICENSE Version 2", "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-only", "Released under the GPLv3."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD license."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 1.0."],
    "eupl": ["Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence.", "SPDX-License-Identifier: EUPL-1.2"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License", "SPDX-License-Identifier: BSL-1.0"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib license.", "SPDX-License-Identifier: Zlib"],
    "artistic": ["This package is free software; you may redistribute it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under CC BY-NC 4.0 International.", "Licensed under CC BY-NC-SA 3.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "public-domain": ["This work is dedicated to the public domain.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
    "wtfpl": ["Do What The Fuck You Want To Public License", "Licensed under the WTFPL.", "SPDX-License-Identifier: WTFPL"],
    "proprietary": ["All rights reserved worldwide.", "Copyright 2020 Example Inc. All rights reserved worldwide.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
# Prose that is no licence notice but shares words with some.
OTHER: list[str] = [
    "The driver must renew the license of the car before the end of the year.", "A license to practice medicine is issued by the state board.", "The committee granted permission to build the bridge.", "This work is the result of many years of study.", "All the people of the city reserved a seat for the play.", "The general public was invited to the first version of the show.", "The source of the river was found under a hill.",
    "The terms of the treaty were published by the foundation.", "He was released under the condition that he return.", "The clause was removed from the contract by the court.", "She works at the institute of technology and teaches software design.", "The domain of the function is the set of real numbers.", "A public meeting was held in the general store.", "You may use the file to smooth the wood.", "Version 2.0 of the program adds a new window.",
    "The helicopter flew over the camp of the apache people.", "The following conditions are met in most of the cases.", "Creative people in common rooms write attribution lists.", "The of and to in that it was for on are as with his they at be this.", "Free of charge for any person under the age of ten.", "The rights of the members were discussed at length.", "The copy of the letter was dated 4.0 weeks ago.",
]


def terms_of(text: Column) -> Column:
    """Distinct word 1- and 2-grams of lower-cased text (words are runs of letters, digits, + and .-joined numbers)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def plain_terms(text: str) -> set[str]:
    """The same on the driver."""
    words = re.findall(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*", text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _samples() -> list[tuple[set[str], str, int]]:
    """(n-grams, family, number of the notice within its family; -1 for other prose) of the training texts."""
    out = []
    for f in sorted(NOTICES):
        for i, t in enumerate(NOTICES[f]):
            # a notice inside other prose is still a notice, and single words of it are none
            out += [(plain_terms(t), f, i), *((plain_terms(t) | plain_terms(o), f, i) for o in OTHER[:3])]
    return out + [(plain_terms(t), UNKNOWN, -1 - i) for i, t in enumerate(OTHER)]


def _matrix(samples, place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(samples), len(place)), np.float32)
    for row, (s, *_) in enumerate(samples):
        x[row, [place[t] for t in s if t in place]] = 1
    return x


def _fit(x: np.ndarray, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient steps; every class weighs the same."""
    y = np.eye(n, dtype=np.float32)[label]
    balance = (1 / np.maximum(y.sum(0), 1))[label]
    balance /= balance.sum()
    w, b = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) * balance[:, None].astype(np.float32)
        w -= RATE * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
        b -= RATE * d.sum(0)
    return w, b


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, list[str]]:
    """(families, weights of each n-gram, biases, anchor n-grams); weights are rounded to 4 digits."""
    families = sorted(NOTICES)
    labels = [*families, UNKNOWN]
    samples = _samples()
    place = {t: i for i, t in enumerate(sorted({t for s, *_ in samples for t in s}))}
    w, b = _fit(_matrix(samples, place), np.array([labels.index(f) for _, f, _ in samples]), len(labels))
    w, b = w.astype(float).round(4), b.astype(float).round(4)
    other = {t for o in OTHER for t in plain_terms(o)}
    used = {t: w[i] for t, i in place.items() if np.abs(w[i]).max() > 0}
    marked = lambda t: any(f" {m} " in f" {t} " for m in MARKERS)
    anchors = sorted(t for t in used if marked(t) and t not in other)
    return families, used, b, anchors


@lru_cache(maxsize=1)
def temperature() -> float:
    """Divides the scores so that notices the fit has not seen are as often right as their probability says.

    In each fold every FOLDS-th notice of each family (and text of the other prose) is left out; the
    temperature with the highest likelihood of the left-out texts' labels is taken.
    """
    labels = [*sorted(NOTICES), UNKNOWN]
    samples = _samples()
    place = {t: i for i, t in enumerate(sorted({t for s, *_ in samples for t in s}))}
    x, y = _matrix(samples, place), np.array([labels.index(f) for _, f, _ in samples])
    fold = np.array([i % FOLDS for *_, i in samples])
    scores = np.zeros((len(samples), len(labels)))
    for k in range(FOLDS):
        w, b = _fit(x[fold != k], y[fold != k], len(labels))
        scores[fold == k] = x[fold == k] @ w + b
    heats = [0.2 * 1.15**i for i in range(24)]

    def loss(heat: float) -> float:
        z = scores / heat
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y]).mean())

    return round(min(heats, key=loss), 6)


def _key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))


def _gate(text: Column) -> Column:
    """Cheap first test, true of any text with an anchor: it holds the longest word of a marker."""
    low = F.lower(text)
    test = F.lit(False)
    for word in sorted({max(m.split(), key=len)[:7] for m in MARKERS}):
        test = test | low.contains(word)
    return test


def _anchored(rows: DataFrame) -> DataFrame:
    """Rows whose paragraph holds an anchor, with its terms."""
    rows = rows.where(_gate(F.col("paragraph"))).withColumn("terms", terms_of(F.col("paragraph")))
    return rows.where(F.arrays_overlap("terms", F.array(*[F.lit(a) for a in model()[3]])))


def paragraphs(docs: DataFrame) -> DataFrame:
    """key, pos, paragraph, terms of lines that hold an anchor."""
    text = F.col("text").cast("string")
    return _anchored(docs.where(_gate(text)).select(_key().alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "paragraph")))


def wrapped(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The same of runs of two lines or more: those between lines without words and the confirmed lines (key, pos).

    pos is the run's first line.
    """
    text = F.col("text").cast("string")
    done = confirmed.groupBy("key").agg(F.collect_set("pos").alias("done"))
    done = F.broadcast(done) if done.count() <= BROADCAST_KEYS else done
    rows = docs.where(text.contains("\n")).where(_gate(text)).select(_key().alias("key"), F.split(text, "\n").alias("lines")).join(done, "key", "left")
    ends = lambda x, i: ~x.rlike(r"[\p{L}\p{N}]") | F.coalesce(F.array_contains("done", i), F.lit(False))
    rows = rows.select("key", F.transform("lines", lambda x, i: F.when(ends(x, i), F.lit("")).otherwise(x)).alias("own"))
    starts = F.filter(F.transform("own", lambda x, i: F.when((x != "") & ((i == 0) | (F.get("own", i - 1) == "")), i)), lambda i: i.isNotNull())
    runs = F.split(F.regexp_replace(F.array_join("own", "\n"), r"\A\n+|\n+\z", ""), r"\n\n+")
    rows = rows.select("key", F.inline(F.arrays_zip(starts.alias("pos"), runs.alias("paragraph"))).alias("pos", "paragraph"))
    return _anchored(rows.where("pos is not null").where(F.col("paragraph").contains("\n")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per line or run of lines in which a family is found: key, pos, family, probability, overlap, paragraph.

    key is (doc_id or the lowest number, hash of the text), so repeated rows have one entry.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_scan(docs, scratch, ["paragraph"]), "found")


def _scan(docs: DataFrame, scratch: Scratch, more: list[str]) -> DataFrame:
    columns = ["key", "pos", "family", "probability", "overlap", *more]
    # without the paragraphs, both readers of the candidates share one exchange
    lines = scratch.keep(_confirmed(paragraphs(docs)).select(*columns), "lines")
    free_shuffles(docs.sparkSession)
    runs = scratch.keep(_confirmed(wrapped(docs, lines.select("key", "pos"))).select(*columns), "runs")
    free_shuffles(docs.sparkSession)
    return lines.union(runs)


def _confirmed(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    families, weights, bias, _ = model()
    labels = [*families, UNKNOWN]
    rows = [("", f, float(b)) for f, b in zip(labels, bias, strict=True)]  # every paragraph has the empty term
    rows += [(t, labels[i], float(v)) for t, w in weights.items() for i, v in enumerate(w) if v]
    table = F.broadcast(spark.createDataFrame(rows, "term string, family string, weight double"))  # a few thousand rows, fixed
    notices = F.broadcast(spark.createDataFrame([(f, sorted({x for x in plain_terms(t) if " " not in x})) for f in families for t in NOTICES[f]], "family string, words array<string>"))
    found = found.dropDuplicates(["key", "pos"])
    heat = temperature()
    scored = found.select("key", "pos", F.explode(F.array_append("terms", "")).alias("term")).join(table, "term").groupBy("key", "pos", "family").agg((F.sum("weight") / heat).alias("z"))
    seen = scored.groupBy("key", "pos").agg(F.max(F.struct("z", "family")).alias("best"), F.max("z").alias("top"), F.collect_list("z").alias("zs"))
    mass = F.aggregate("zs", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    best = seen.select("key", "pos", F.col("best.family").alias("family"), (1 / mass).alias("probability")).where(F.col("family") != UNKNOWN).where(F.col("probability") >= THRESHOLD)
    overlap = F.size(F.array_intersect("terms", "words")) / F.size("words")
    near = best.join(found.select("key", "pos", "paragraph", "terms"), ["key", "pos"]).join(notices, "family").groupBy("key", "pos").agg(F.first("family").alias("family"), F.first("probability").alias("probability"), F.max(overlap).alias("overlap"), F.first("paragraph").alias("paragraph"))
    return near.where(F.col("overlap") >= CONFIRM)


def document_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, licenses (families, sorted, comma-joined; unknown without any),
    n_paragraphs (confirmed), confidence (highest probability; 0 without any).

    Null and empty texts are unknown. Repeated rows get equal results. Other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")).alias("key"))
        found = scratch.keep(_scan(docs, scratch, []).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_paragraphs"), F.round(F.max("probability"), 6).alias("confidence")), "licenses")
        out = own.join(found, "key", "left")
        return scratch.result(out.select("doc_id", F.coalesce("licenses", F.lit(UNKNOWN)).alias("licenses"), F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")), "scanned")


def oracle_sql() -> str:
    """document_licenses of the table documents as DuckDB SQL, with the model's numbers written out."""
    families, weights, bias, anchors = model()
    labels = [*families, UNKNOWN]
    rows = [("", f, float(b)) for f, b in zip(labels, bias, strict=True)]
    rows += [(t, labels[i], float(v)) for t, w in weights.items() for i, v in enumerate(w) if v]
    notices = [(f, sorted({x for x in plain_terms(t) if " " not in x})) for f in families for t in NOTICES[f]]
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"""
WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{f}', {v!r}::DOUBLE)" for t, f, v in rows)}) AS t(term, family, weight)
), nt AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {listed(ws)})" for f, ws in notices)}) AS t(family, words)
), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS paragraph FROM documents
), u AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(paragraph), '[a-z]+[0-9]*|[0-9]+(?:\\.[0-9]+)*') AS ws FROM l
), t AS (SELECT id, doc_id, ws, list_distinct(list_concat(ws, CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END)) AS terms FROM u
), c AS (SELECT * FROM t WHERE list_has_any(terms, {listed(anchors)})
), z AS (SELECT id, w.family, sum(w.weight) / {temperature()!r} AS z FROM (SELECT id, unnest(list_append(terms, '')) AS term FROM c) e JOIN w USING (term) GROUP BY id, w.family
), b AS (SELECT id, arg_max(family, z) AS family, 1 / sum(exp(z - top)) AS p FROM (SELECT *, max(z) OVER (PARTITION BY id) AS top FROM z) GROUP BY id
), f AS (
  SELECT c.id, c.doc_id, b.family, b.p FROM b JOIN c USING (id) JOIN nt ON nt.family = b.family
  WHERE b.family <> '{UNKNOWN}' AND b.p >= {THRESHOLD} GROUP BY ALL HAVING max(len(list_intersect(c.ws, nt.words)) / len(nt.words)) >= {CONFIRM}
), g AS (SELECT doc_id, string_agg(DISTINCT family, ',' ORDER BY family) AS licenses, count(*) AS n, round(max(p), 6) AS p FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.licenses, '{UNKNOWN}') AS licenses, coalesce(g.n, 0) AS n_paragraphs, coalesce(g.p, 0.0)::DOUBLE AS confidence FROM documents d LEFT JOIN g USING (doc_id)
"""
