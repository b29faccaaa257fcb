"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text. Its hashed word 1- to 3-grams that occur in any template are the features of a sparse
multinomial logistic regression over the licence families and a class `unknown`. It is fitted on altered copies of the
templates (words dropped, replaced and added around) and, for `unknown`, on lines of a bounded sample of the corpus and
on sentences that speak of licences without granting one; a temperature, chosen on held-back rows, calibrates the
probabilities. A paragraph that `unknown` doesn't win is then compared with the templates of its family: confirmed if
the share of its 2-grams found in one template, or of a template's 2-grams found in it, reaches `least_overlap`.

A scan is one pass over whole texts without a shuffle; the model is bounded by the templates.

Defined results: null and empty texts have no paragraphs; blank lines count as none; equal texts have equal results; a
doc_id may be null or repeat, each row is scanned by itself; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, text_buffer
from .quality import plain
from .textfeat import ngrams, words
from .toxicity import Vocabulary, counted

UNKNOWN = "unknown"
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPLv3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Boost": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Proprietary": ("All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential."),
}
NEAR_MISSES = (
    "He lost his driving license last year.", "The license plate of the car was unreadable.", "The city issued a liquor license to the bar.", "You need a fishing license to fish here.",
    "Copyright law was debated in parliament.", "The company sells software to any person.", "The public was free to use the library.", "MIT is a university in Massachusetts.",
    "The Apache helicopter flew over the city.", "The museum is open to the general public.", "A new version of the program was released.", "The license was revoked under the terms of the agreement.",
    "The warranty covers parts and labour.", "All rights of the tenants were reserved for later.", "The work is done under a contract.", "Version 2.0 was released in May.", "We redistribute the income.",
    "The foundation published the report.", "Common creative work needs time.", "The distribution of the data is normal.", "Permission to enter was granted.", "The bar at the boost station is closed.",
)


def _grams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, h, _, first = words(raw, np.array([0, len(raw)], np.int64))
    return np.concatenate([ngrams(h, first, k)[0] + np.uint64(k) for k in (1, 2, 3)])


def _altered(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    w = text.split()
    w = [x for x in w if rng.random() > 0.06] or w
    w = [filler[rng.integers(len(filler))] if filler and rng.random() < 0.04 else x for x in w]
    if len(w) > 14 and rng.random() < 0.4:  # a part, as of a wrapped text
        a = int(rng.integers(0, len(w) - 10))
        w = w[a : a + int(rng.integers(10, len(w) - a + 1))]
    if filler and rng.random() < 0.5:
        some = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(1, 12)))]
        w = some + w if rng.random() < 0.5 else w + some
    return " ".join(w)


def paragraphs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each line with a word, by bytes of the buffer."""
    cut = np.union1d(off, np.flatnonzero(raw == 10) + 1)
    s, e = cut[:-1], cut[1:]
    return np.searchsorted(off, s, "right") - 1, s, e


@dataclass
class Model:
    families: list[str]
    vocabulary: Vocabulary
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, np.ndarray]]  # family, distinct 2-grams
    least: float
    overlap: float

    def probabilities(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        z = np.tile(self.bias, (n, 1))
        np.add.at(z, rows, self.weights[features])
        z = (z - z.max(axis=1, keepdims=True)) / self.temperature
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def scan(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Paragraphs of each text; hits as text, paragraph, start, length, family, probability, overlap, confirmed."""
        n = len(off) - 1
        doc, s, e = paragraphs(raw, off)
        _, _, h, _, first = words(raw, np.append(s, len(raw)).astype(np.int64))
        full = np.diff(first) > 0
        count = np.bincount(doc[full], minlength=n)
        rows, keys, pairs = [], [], None
        for k in (1, 2, 3):
            g, gf = ngrams(h, first, k)
            if k == 2:
                pairs = (g, gf)
            g = g + np.uint64(k)
            i = np.flatnonzero(self.vocabulary.map[g >> np.uint64(48)])
            j = np.minimum(np.searchsorted(self.vocabulary.keys, g[i]), len(self.vocabulary.keys) - 1)
            ok = self.vocabulary.keys[j] == g[i]
            rows.append(np.searchsorted(gf, i[ok], "right") - 1)
            keys.append(j[ok])
        r, k, _ = counted(np.concatenate(rows), np.concatenate(keys))
        some, at = np.unique(r, return_inverse=True)
        p = self.probabilities(at, k, len(some))
        best = p.argmax(axis=1)
        out = []
        order = np.cumsum(full) - 1
        for i in np.flatnonzero((best > 0) & (p[:, 0] < 1 - self.least)):
            line, family = int(some[i]), int(best[i])
            own = np.unique(pairs[0][pairs[1][line] : pairs[1][line + 1]])
            share = 0.0
            for f, t in self.templates:
                if f == family:
                    both = len(np.intersect1d(own, t, assume_unique=True))
                    share = max(share, both / len(own), both / len(t))
            d = int(doc[line])
            nth = int(order[line]) - (int(np.searchsorted(doc[full], d)))
            out.append((d, nth, int(s[line] - off[d]), int(e[line] - s[line]), self.families[family], float(p[i, family]), share, share >= self.overlap))
        return count, out


def train(background: list[str], least: float = 0.5, least_overlap: float = 0.5, copies: int = 60, l2: float = 1e-6, steps: int = 200, seed: int = 5) -> Model:
    """Fit on altered templates against `background` lines and near misses."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    vocabulary = Vocabulary(np.unique(np.concatenate([_grams(t) for ts in TEMPLATES.values() for t in ts])))
    templates = [(i, np.unique(_pairs(t))) for i, f in enumerate(families) if i for t in TEMPLATES[f]]
    known = Model(families, vocabulary, np.zeros((len(vocabulary.keys), len(families))), np.zeros(len(families)), 1.0, templates, least, least_overlap)
    plain_lines = [b for b in background if _overlap(known, b) < 0.5]
    filler = [w for b in plain_lines[:300] for w in b.split()[:20]]
    data = [(t, i) for i, f in enumerate(families) if i for t0 in TEMPLATES[f] for t in [t0, *(_altered(t0, rng, filler) for _ in range(copies))]]
    data += [(t, 0) for t in plain_lines] + [(t, 0) for m in NEAR_MISSES for t in [m, *(_altered(m, rng, filler) for _ in range(copies))]]
    order = rng.permutation(len(data))
    rows, feats = [], []
    for i, j in enumerate(order):
        g = np.unique(_grams(data[j][0]))
        k = np.minimum(np.searchsorted(vocabulary.keys, g), len(vocabulary.keys) - 1)
        k = k[vocabulary.keys[k] == g]
        rows.append(np.full(len(k), i))
        feats.append(k)
    r, f = np.concatenate(rows), np.concatenate(feats)
    y = np.array([data[j][1] for j in order])
    n, c = len(y), len(families)
    learn = np.arange(n) % 5 != 0
    own = learn[r]
    w, b = np.zeros((len(vocabulary.keys), c)), np.zeros(c)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    hot = np.eye(c)[y]
    by = np.argsort(f[own], kind="stable")
    ro, fo = r[own][by], f[own][by]
    at = np.flatnonzero(np.r_[True, fo[1:] != fo[:-1]]) if len(fo) else np.zeros(0, np.int64)
    rs, fs = r[own], f[own]
    line = np.flatnonzero(np.r_[True, rs[1:] != rs[:-1]]) if len(rs) else np.zeros(0, np.int64)

    def logits(rr, ff, starts):
        z = np.tile(b, (n, 1))
        if len(starts):
            z[rr[starts]] += np.add.reduceat(w[ff], starts, axis=0)
        return z

    for t in range(1, steps + 1):
        z = logits(rs, fs, line)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hot) * learn[:, None] / learn.sum()
        gw, gb = l2 * w, d.sum(axis=0)
        if len(at):
            gw[fo[at]] += np.add.reduceat(d[ro], at, axis=0)
        m[0], m[1] = 0.9 * m[0] + 0.1 * gw, 0.999 * m[1] + 0.001 * gw * gw
        m[2], m[3] = 0.9 * m[2] + 0.1 * gb, 0.999 * m[3] + 0.001 * gb * gb
        w -= 0.05 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-9)
        b -= 0.05 * (m[2] / (1 - 0.9**t)) / (np.sqrt(m[3] / (1 - 0.999**t)) + 1e-9)
    # the temperature that makes held-back rows likeliest
    z = logits(r, f, np.flatnonzero(np.r_[True, r[1:] != r[:-1]]))[~learn]
    grid = np.geomspace(0.25, 8, 25)
    loss = [np.mean(np.log(np.exp((z - z.max(axis=1, keepdims=True)) / t).sum(axis=1)) - ((z - z.max(axis=1, keepdims=True)) / t)[np.arange(len(z)), y[~learn]]) for t in grid]
    known.weights, known.bias, known.temperature = w, b, float(grid[int(np.argmin(loss))])
    return known


def _pairs(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, h, _, first = words(raw, np.array([0, len(raw)], np.int64))
    return ngrams(h, first, 2)[0]


def _overlap(model: Model, text: str) -> float:
    own = np.unique(_pairs(text))
    if not len(own):
        return 0.0
    both = [(len(np.intersect1d(own, t, assume_unique=True)), len(t)) for _, t in model.templates]
    return max(max(b / len(own), b / t) for b, t in both)


def fit(docs: DataFrame, documents: int = 1000, lines: int = 2000, **options) -> Model:
    """Train with background lines of at most `documents` texts, chosen by a hash of doc_id; `lines` bounds the rows collected."""
    ids = plain(docs).where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(documents).distinct()
    own = plain(docs).join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0").select(F.substring("line", 1, 2000).alias("line"))
    got = own.orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    return train([r["line"] for r in got], **options)


_HIT = "doc_id long, paragraph long, start long, length long, family string, probability double, overlap double, confirmed boolean"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each paragraph that a licence family wins: place in bytes, family, probability, overlap with the nearest template, confirmed."""
    return _scan(docs, model).select(F.explode("hits").alias("h"), "doc_id").select("doc_id", *[f"h.{c.split()[0]}" for c in _HIT.split(", ")[1:]])


def by_document(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: n_paragraphs, n_hits, n_confirmed, family and probability of its likeliest confirmed paragraph (the first of equals)."""
    confirmed = F.filter("hits", lambda h: h["confirmed"])
    best = F.try_element_at(F.array_sort(F.transform(confirmed, lambda h: F.struct((-h["probability"]).alias("p"), h["paragraph"].alias("n"), h["family"].alias("f")))), F.lit(1))
    return _scan(docs, model).select("doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_hits"), F.size(confirmed).cast("long").alias("n_confirmed"), best["f"].alias("family"), (-best["p"]).alias("probability"))


def _scan(docs: DataFrame, model: Model) -> DataFrame:
    names = [c.split()[0] for c in _HIT.split(", ")][1:]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            count, hits = model.scan(*text_buffer(b.column("text")))
            hits.sort(key=lambda h: h[:2])
            cut = np.searchsorted([h[0] for h in hits], np.arange(b.num_rows + 1)).astype(np.int32) if hits else np.zeros(b.num_rows + 1, np.int32)
            struct = pa.StructArray.from_arrays([pa.array([h[k + 1] for h in hits], kind) for k, kind in enumerate(kinds)], names=names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), pa.ListArray.from_arrays(pa.array(cut), struct)], names=["doc_id", "n_paragraphs", "hits"])

    return plain(docs).mapInArrow(rows, f"doc_id long, n_paragraphs long, hits array<struct<{', '.join(c.replace(' ', ': ') for c in _HIT.split(', ')[1:])}>>")
