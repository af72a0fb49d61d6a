"""Licence scan: a trained classifier of notices, confirmed by comparison with templates.

A paragraph is a run of lines that aren't blank, read without comment signs and across line ends, so
a notice wrapped over several lines, in a comment or inside other text is one stretch of words. A
family's spans are the stretches of a paragraph in which two-word sequences of its templates follow
each other at no more than ``gap`` words, with ``pad`` words on either side.

A sparse multinomial logistic regression (L1, so most weights are zero) over the distinct one- and
two-word sequences of a span gives each licence family and the unknown class a probability. It is
fitted to whole, cut and damaged templates, and for the unknown class to sentences, mixtures and at
most ``negatives`` spans of the documents which resemble no template; a temperature fitted to other
variants calibrates it. A span counts if its own family is the most probable class with
``min_score`` and a template of the family confirms it: the span holds ``min_similarity`` of the
template's sequences (``min_short`` of a template of fewer than ``short``), or at least ``short``
of the template's sequences make up ``min_similarity`` of the span's.

Documents are scored by built-in functions only: one pass over the texts finds the spans, which are
written and then scored without a shuffle.

Defined results: a null, empty or blank text has no paragraphs and no licence. Repeated rows are
scanned alike. Ties go to the earlier span and the family that sorts first. Long texts are
scanned whole. Columns beside id and text are ignored.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.llm.common import written

UNKNOWN = "unknown"

#: Notices and openings of public licences.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Licensed under the BSD license.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc0": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Released under the GNU GPL version 2.",
        "Licensed under the GPL v3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
}
#: Identifiers of the licences in the short form of the public list.
IDENTIFIERS = {
    "agpl": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "apache-2.0": "Apache-2.0",
    "boost": "BSL-1.0",
    "bsd": "BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD",
    "cc-by": "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0",
    "cc-by-nc": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0",
    "cc0": "CC0-1.0",
    "epl": "EPL-1.0 EPL-2.0",
    "gpl": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "isc": "ISC",
    "lgpl": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later",
    "mit": "MIT MIT-0",
    "mpl-2.0": "MPL-2.0",
    "unlicense": "Unlicense",
    "zlib": "Zlib",
}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {n}" for n in _names.split()]
#: Sentences that use such words without granting a licence.
OTHERS = [
    "She renewed her driving license at the public office before the general election.",
    "Copyright law is taught at the university and students at MIT work on software.",
    "The Apache people lived in the south and the helicopter has the same name.",
    "The source of the river is free to visit for any person without charge.",
    "A version of the work was released in the following year.",
    "The creative work of the commons was distributed in written form.",
    "All rights reserved.",
    "Terms and conditions apply to the offer as is provided by law.",
    "The foundation published a list of public libraries with this notice.",
    "The license to fish expired, and the permission was not granted by the office.",
    "See the documentation for a copy of the file and the list of materials.",
    "Mozilla and GNU are names of projects.",
    "This license agreement is between you and the company.",
]
EVERYDAY = frozenset(
    "the a an and or of to in is are be this that it for with on as by at from not if you can may all any other your has have was were "
    "s under its their which who into out up no we he she they will would 0 1 2 3 4 do does one see http https www org".split()
)


BREAK = "\u2029"
#: Signs that open a line of a comment, and those that close one.
OPENING = r"(?m)^[ \t]*+(?:(?://[/!]?|/\*+|\*+/?|#+|;+|--+|%+|<!--|\"\"\"|(?i:rem|dnl)\b)[ \t]*+)?"
CLOSING = r"(?m)[ \t]*+(?:\*+/|-->)[ \t\r]*+$"


@dataclass(frozen=True)
class Settings:
    """``negatives`` bounds the spans of documents that the unknown class is learned from."""

    min_score: float = 0.6
    min_similarity: float = 0.6
    min_short: float = 0.75
    short: int = 8
    gap: int = 10
    pad: int = 3
    negatives: int = 400
    l1: float = 0.0002
    rounds: int = 400
    variants: int = 10


@dataclass(frozen=True)
class Model:
    classes: list[str]
    weights: dict[str, list[float]]  # of features with any weight
    bias: list[float]
    temperature: float


def tokens(paragraph: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", paragraph.lower()) if w]


def grams(words: list[str]) -> set[str]:
    return set(words) | set(pairs(words))


def pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling(gram: str) -> bool:
    return any(w not in EVERYDAY for w in gram.split())


@lru_cache(maxsize=1)
def template_pairs() -> dict[str, list[list[str]]]:
    """The two-word sequences of each family's templates."""
    return {f: [pairs(tokens(t)) for t in ts] for f, ts in sorted(TEMPLATES.items())}


@lru_cache(maxsize=1)
def features() -> list[str]:
    return sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t)) if telling(g)})


def _variants(rng: random.Random, n: int) -> list[tuple[set[str], str]]:
    """Templates, their parts and damaged copies, beside sentences, mixtures and empty spans of the unknown class."""
    rows: list[tuple[set[str], str]] = []
    everything: list[str] = []
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = tokens(text)
            everything += words
            rows += [(grams(words), family)] * 3
            for _ in range(n):
                if len(words) < 9:  # every word of a short notice counts; others may stand beside it
                    beside = [rng.choice(everything) for _ in range(rng.randint(0, 3))]
                    rows.append((grams(beside + words if rng.random() < 0.5 else words + beside), family))
                    continue
                kept = [w for w in words if rng.random() > 0.1]
                cut = rng.randint(0, len(kept) // 4)
                rows.append((grams(kept[cut:] if rng.random() < 0.5 else kept[: len(kept) - cut]), family))
    for text in OTHERS:
        words = tokens(text)
        rows += [(grams([w for w in words if rng.random() > 0.15]), UNKNOWN) for _ in range(2 * n)]
    rows += [(grams([rng.choice(everything) for _ in range(rng.randint(0, 6))]), UNKNOWN) for _ in range(60 * n)]
    return rows


@lru_cache(maxsize=4)
def fit(s: Settings = Settings(), negatives: tuple[tuple[str, ...], ...] = ()) -> Model:
    """Proximal gradient steps on variants and negatives (grams of spans); the same model for the same input."""
    rng = random.Random(7)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    place = {g: i for i, g in enumerate(features())}
    rank = {c: i for i, c in enumerate(classes)}

    def table(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(place)), np.float32)
        y = np.zeros((len(rows), len(classes)), np.float32)
        for i, (held, family) in enumerate(rows):
            x[i, [place[g] for g in held if g in place]] = 1.0
            y[i, rank[family]] = 1.0
        return x, y

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = table(_variants(rng, s.variants) + [(set(g), UNKNOWN) for g in negatives])
    w, b = np.zeros((len(place), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    step = 0.5
    for _ in range(s.rounds):
        wrong = (softmax(x @ w + b) - y) / len(x)
        w -= step * (x.T @ wrong)
        b -= step * wrong.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * s.l1, 0.0)
    hx, hy = table(_variants(rng, 4))
    z = hx @ w + b
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum((softmax(z / t) * hy).sum(axis=1), 1e-12)).mean() for t in grid]
    used = {g: [round(float(v), 6) for v in w[i]] for g, i in place.items() if w[i].any()}
    return Model(classes, used, [round(float(v), 6) for v in b], float(grid[int(np.argmin(loss))]))


def _among(name: str, values: list[str]) -> str:
    """SQL of a lookup in a fixed set of words (letters, digits and blanks only)."""
    return f"{name} IN ({', '.join(repr(v) for v in values)})"


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _twos(words: Column) -> Column:
    """Neighbouring words, joined."""
    n = F.size(words)
    return F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)
    )


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, n_paragraphs and spans: family, paragraph (from 0), words, one and two (distinct sequences), near (best share of a template)."""
    wall = f" {BREAK}" * (s.gap + s.pad + 1)
    anchors = {f: sorted({p for t in ts for p in t if telling(p)}) for f, ts in template_pairs().items()}
    every = sorted({p for ps in anchors.values() for p in ps})
    firsts = sorted({p.split()[0] for p in every})
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BREAK, "\n\n")
    bare = docs.select(
        F.col(doc_id).alias("doc_id"), F.trim(F.regexp_replace(F.regexp_replace(raw, CLOSING, ""), OPENING, ""), F.lit(" \t\r\n")).alias("t")
    )
    # the steps are separate projections, so that each array is made once
    worded = bare.select(
        "doc_id",
        F.filter(F.split(F.lower(F.regexp_replace("t", r"\n(?:[ \t\r]*+\n)++", wall + " ")), f"[^a-z0-9{BREAK}]+"), lambda w: w != "").alias("words"),
        F.when(F.col("t").rlike("\\S"), F.size(F.split("t", r"\n(?:[ \t\r]*+\n)++"))).otherwise(0).cast("long").alias("n_paragraphs"),
    )
    hit = worded.select(
        "*",
        F.expr(
            f"filter(transform(words, (w, i) -> if({_among('w', firsts)}, struct(i as i, concat_ws(' ', w, get(words, i + 1)) as p), null)), "
            f"h -> {_among('h.p', every)})"
        ).alias("hits"),
    )
    own = hit.select(
        "doc_id", "n_paragraphs", F.when(F.size("hits") > 1, F.col("words")).alias("words"),  # else there is no span
        *[F.expr(f"transform(filter(hits, h -> {_among('h.p', ps)}), h -> h.i)").alias(f"at_{k}") for k, ps in enumerate(anchors.values())],
    )

    def stretches(k: int, family: str) -> Column:
        at = F.col(f"at_{k}")
        far = lambda a, b: F.coalesce(b - a > s.gap, F.lit(True))
        numbered = F.transform(at, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        first = F.filter(numbered, lambda r: far(F.when(r["i"] > 0, F.get(at, r["i"] - 1)), r["x"]))
        last = F.filter(numbered, lambda r: far(r["x"], F.get(at, r["i"] + 1)))
        both = F.zip_with(
            first, last, lambda a, b: F.struct(F.lit(family).alias("family"), a["x"].alias("a"), b["x"].alias("b"), (b["i"] - a["i"] + 1).alias("n"))
        )
        return F.filter(both, lambda r: r["n"] > 1)  # a single sequence is below the threshold of every template

    found = own.select("doc_id", "n_paragraphs", "words", F.flatten(F.array(*[stretches(k, f) for k, f in enumerate(anchors)])).alias("r"))
    cut = found.select(
        "doc_id",
        "n_paragraphs",
        F.transform(
            "r",
            lambda r: F.struct(
                r["family"].alias("family"),
                (F.size(F.filter(F.slice("words", 1, r["a"]), lambda w: w == BREAK)) / (s.gap + s.pad + 1)).cast("long").alias("paragraph"),
                r["a"].alias("a"),
                F.filter(
                    F.slice("words", F.greatest(r["a"] - s.pad, F.lit(0)) + 1, r["b"] + 2 + s.pad - F.greatest(r["a"] - s.pad, F.lit(0))),
                    lambda w: w != BREAK,
                ).alias("words"),
            ),
        ).alias("r"),
    )
    paired = cut.select(
        "doc_id",
        "n_paragraphs",
        F.transform("r", lambda r: r.withField("one", F.array_distinct(r["words"])).withField("two", F.array_distinct(_twos(r["words"])))).alias("r"),
    )
    known = F.from_json(
        F.lit(json.dumps([{"family": f, "pairs": t} for f, ts in template_pairs().items() for t in ts])),
        "array<struct<family:string,pairs:array<string>>>",
    )

    def share(both: Column, size: Column, two: Column) -> Column:
        """Share of the template held, or of the span; over 1 where a short template's own threshold is met."""
        held = both / size
        scaled = F.when(size < s.short, held * s.min_similarity / s.min_short).otherwise(held)
        return F.greatest(scaled, F.when(both >= s.short, both / F.size(two)).otherwise(0.0))

    return paired.select(
        "doc_id",
        "n_paragraphs",
        F.transform(
            "r",
            lambda r: r.withField(
                "near",
                F.array_max(
                    F.transform(
                        F.filter(known, lambda t: t["family"] == r["family"]),
                        lambda t: share(F.size(F.array_intersect(t["pairs"], r["two"])), F.size(t["pairs"]), r["two"]),
                    )
                ),
            ),
        ).alias("spans"),
    )


def unlike(found: DataFrame, s: Settings = Settings()) -> tuple[tuple[str, ...], ...]:
    """Features of at most ``negatives`` distinct spans, chosen by hash, that hold less than half of what a template needs."""
    far = found.select(F.explode(F.filter("spans", lambda r: r["near"] < s.min_similarity / 2)).alias("r"))
    held = far.select(F.sort_array(F.array_intersect(F.concat("r.one", "r.two"), _strings(features()))).alias("g")).distinct()
    return tuple(tuple(x.g) for x in held.orderBy(F.xxhash64("g"), "g").limit(s.negatives).collect())


def scored(found: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_paragraphs and found: the accepted spans in order, each with family, score, similarity, paragraph and text."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    bias = F.array(*[F.lit(v) for v in model.bias])
    names = F.array(*[F.lit(c) for c in model.classes])
    summed = found.select(
        "doc_id",
        "n_paragraphs",
        F.transform(
            F.filter("spans", lambda r: r["near"] >= s.min_similarity),
            lambda r: r.withField(
                "z",
                F.aggregate(
                    F.array_intersect(F.concat(r["one"], r["two"]), _strings(list(model.weights))),
                    bias,
                    lambda a, g: F.zip_with(a, weights[g], lambda u, v: u + v),
                    lambda a: F.transform(a, lambda v: v / model.temperature),
                ),
            ),
        ).alias("r"),
    )
    judged = summed.select(
        "doc_id",
        "n_paragraphs",
        F.transform(
            "r",
            lambda r: F.struct(
                r["paragraph"].alias("paragraph"),
                r["a"].alias("a"),
                r["family"].alias("family"),
                F.element_at(names, F.array_position(r["z"], F.array_max(r["z"])).cast("int")).alias("said"),
                (F.lit(1.0) / F.aggregate(r["z"], F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(r["z"])))).alias("score"),
                r["near"].alias("similarity"),
                F.concat_ws(" ", r["words"]).alias("text"),
            ),
        ).alias("r"),
    )
    ok = F.filter("r", lambda r: (r["said"] == r["family"]) & (r["score"] >= s.min_score))
    kept = F.transform(ok, lambda r: r.dropFields("said"))
    return judged.select("doc_id", "n_paragraphs", F.sort_array(kept).alias("found"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, n_paragraphs, found (accepted spans in order) and the document's family, score and similarity."""
    all_spans = written(spans(docs, doc_id, text, s), "licence-spans")
    held = scored(all_spans, fit(s, unlike(all_spans, s)), s)
    first = F.sort_array(
        F.transform(
            "found",
            lambda r: F.struct((-r["score"]).alias("s"), r["paragraph"].alias("p"), r["a"].alias("a"), r["family"].alias("f"), r["similarity"].alias("m")),
        )
    )
    return held.select("doc_id", "n_paragraphs", "found", F.get(first, 0).alias("top")).select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licences"),
        F.col("top.f").alias("family"),
        (-F.col("top.s")).alias("score"),
        F.col("top.m").alias("similarity"),
        F.col("top.p").cast("long").alias("paragraph"),
        "found",
    )
