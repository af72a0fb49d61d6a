import re

import numpy as np
import pytest

from covspark.llm import licences
from covspark.llm.licences import BREAK, EVERYDAY, TEMPLATES, UNKNOWN, Settings, features, pairs, telling, template_pairs, tokens

S = Settings()
FILLER = "Onerint thly ousher the of and that erthe in wherth onles."
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 */"""
BSD = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 */
int main() {}"""
CASES = [
    (None, None),
    ("", None),
    (" \n\n", None),
    (FILLER, None),
    ("Released under the MIT License.\n" + FILLER, "mit"),
    (FILLER + "\nLicensed under the Apache License, Version 2.0.\n" + FILLER, "apache-2.0"),
    (FILLER + " This work is licensed under the GNU General Public License, version 3. " + FILLER * 50, "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Copyright law is taught in Apache county and my driving license is under the table.", None),
    ("MIT\nApache\nGNU version 3", None),
    ("x\n" * 3000 + "SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    (GPL + "import os\n", "gpl"),
    ("/*\n" + LGPL + "\n\nint x;", "lgpl"),
    (BSD, "bsd"),
    *[(f"// SPDX-License-Identifier: {n}\npackage x", f) for f, ns in licences.IDENTIFIERS.items() for n in ns.split()],
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    ("The GNU tools and the general public met the free foundation; a license was published at the office.", None),
    ("You can redistribute the chairs and modify the table under the terms of the house.", None),
    ("The MIT licensed its patent under the new law, and the software is free of bugs.", None),
]
TEXTS = [t for t, _ in CASES]


def paragraphs(text):
    """Paragraphs without comment signs, line by line."""
    out, now = [], []
    for line in (text or "").replace(BREAK, "\n\n").split("\n"):
        line = re.sub(r"[ \t]*(\*+/|-->)[ \t\r]*$", "", line)
        line = re.sub(r'^[ \t]*((//[/!]?|/\*+|\*+/?|#+|;+|--+|%+|<!--|"""|(?i:rem|dnl)\b)[ \t]*)?', "", line)
        if line.strip(" \t\r"):
            now.append(line)
        elif now:
            out.append("\n".join(now))
            now = []
    return out + (["\n".join(now)] if now else [])


def brute(text, model):
    """Plain Python over paragraphs, families and positions."""
    out = []
    for number, paragraph in enumerate(paragraphs(text)):
        words = tokens(paragraph)
        for family, templates in template_pairs().items():
            known = {p for t in templates for p in t if telling(p)}
            at = [i for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in known]
            groups = []
            for i in at:
                if groups and i - groups[-1][-1] <= S.gap:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            for g in groups:
                if len(g) < 2:
                    continue
                span = words[max(0, g[0] - S.pad) : g[-1] + 2 + S.pad]
                two = set(pairs(span))
                near = 0.0
                for t in templates:
                    both = len(set(t) & two)
                    near = max(near, both / len(t) * (S.min_similarity / S.min_short if len(t) < S.short else 1), both / len(two) if both >= S.short else 0)
                z = np.array(model.bias) + sum((np.array(model.weights[x]) for x in set(span) | two if x in model.weights), np.zeros(len(model.bias)))
                p = np.exp((z - z.max()) / model.temperature)
                p /= p.sum()
                if near >= S.min_similarity and model.classes[int(p.argmax())] == family and p.max() >= S.min_score:
                    out.append((number, family, float(p.max()), near))
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, family string")
    model = licences.fit(S, licences.unlike(licences.spans(df)))
    return model, {r.doc_id: r for r in licences.scan(df).collect()}


def test_like_plain_python(scanned):
    model, rows = scanned
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        wanted = sorted(brute(text, model))
        got = sorted((x.paragraph, x.family, x.score, x.similarity) for x in rows[i].found)
        assert [g[:2] for g in got] == [w[:2] for w in wanted]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in wanted])
        assert rows[i].n_licences == len(wanted) and rows[i].n_paragraphs == len(paragraphs(text))


def test_families(scanned):
    got = {i: r.family for i, r in scanned[1].items()}
    assert got == {i: f for i, (_, f) in enumerate(CASES)}


def test_two_licences_and_repeated_rows(spark):
    text = FILLER + "\nReleased under the MIT License.\n" + FILLER + "\n\nLicensed under the GNU Lesser General Public License, version 2.1.\n"
    rows = licences.scan(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert len(rows) == 3
    for r in rows:
        assert [(x.paragraph, x.family) for x in r.found] == [(0, "mit"), (1, "lgpl")] and "mit license" in r.found[0].text


def test_long_text(spark):
    text = "\n".join([FILLER] * 20000) + "\n" + GPL + "\n".join([FILLER] * 20000)
    (row,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.family == "gpl" and row.n_paragraphs == 1


def test_documents_teach_the_unknown_class(spark):
    near_miss = "The source code of the general license was free, and the terms of the public version were published."
    df = spark.createDataFrame([(i, near_miss + f" w{i}") for i in range(5)], "doc_id long, text string")
    found = licences.unlike(licences.spans(df))
    assert found and set(found[0]) <= set(features())
    assert len(licences.unlike(licences.spans(df), Settings(negatives=1))) == 1
    assert {r.family for r in licences.scan(df).collect()} == {None}


def test_sparse_and_calibrated():
    model = licences.fit(S)
    weights = np.array(list(model.weights.values()))
    assert (weights == 0).mean() > 0.4 and set(model.weights) <= set(features())
    for name, texts in TEMPLATES.items():
        missed = [t for t in texts if name not in {f for _, f, *_ in brute(t, model)}]
        assert len(missed) <= len(texts) // 4, missed
    assert not [f for t in licences.OTHERS for f in brute(t, model)]
    assert model.classes[-1] == UNKNOWN and "the" in EVERYDAY


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
