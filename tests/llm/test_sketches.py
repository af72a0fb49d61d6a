import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from covspark.llm import sketches
from covspark.llm.queries import QUERIES

SMALL = sketches.Settings(cells=6, chunk_chars=200, samples=2)


def parts_of(text):
    """Paragraphs by hand: line by line, cut behind a full stop, question or exclamation mark before white space."""
    out = []
    for line in text.split("\n"):
        held = ""
        for i, c in enumerate(line):
            held += c
            if c in ".!?" and (i + 1 == len(line) or line[i + 1].isspace()):
                out.append(held)
                held = ""
        out.append(held)
    return Counter(p.strip() for p in out if p.strip())


def alike(a, b):
    x, y = parts_of(a), parts_of(b)
    union = sum((x | y).values())
    return 1.0 if not union else sum((x & y).values()) / union


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def made(r, n):
    words = ["da", "ö", "漢字", "x\U0001f600", "lo.", "la!", "me\n", ". ", "q?"]
    return " ".join(r.choice(words) for _ in range(n))


def test_paragraphs_like_by_hand():
    r = random.Random(3)
    for n in range(200):
        t = made(r, n % 40)
        assert Counter(sketches.paragraphs(t)) == parts_of(t), t


@pytest.mark.parametrize("cells", [3, 24])
def test_peeling_recovers_all_differences(cells):
    r = random.Random(cells)
    lists = [[r.choice("abcdefgh") * r.randrange(1, 40) for _ in range(r.choice([0, 1, 2, 9, 60, 700]))] for _ in range(60)]
    keys, starts = sketches.digests(lists)
    sets = [set(keys[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert [len(s) for s in sets] == [len(x) for x in lists]  # copies of a paragraph count one by one
    pairs = np.array([(i, j) for i in range(60) for j in (i, (i * 7 + 1) % 60, (i + 30) % 60)])
    owner, got, sides, size = sketches.differences(keys, starts, pairs, cells)
    for n, (i, j) in enumerate(pairs):
        assert set(got[(owner == n) & (sides > 0)].tolist()) == sets[i] - sets[j]
        assert set(got[(owner == n) & (sides < 0)].tolist()) == sets[j] - sets[i]
    assert (owner >= 0).sum() == sum(len(sets[i] ^ sets[j]) for i, j in pairs)
    assert size.min() == cells and size.max() > cells  # small differences at once, large ones by retrying


def test_fingerprint_is_the_sketch():
    keys, starts = sketches.digests([["a", "b"], ["b", "a"], [], ["a", "c"]])
    one, two, none, other = sketches.fingerprints(keys, starts, 6)
    assert one == two != other
    cells = np.frombuffer(base64.b64decode(one.split(":")[1]), [("number", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
    assert one.startswith("2:") and cells["number"].sum() == 6 and none.startswith("0:")
    assert np.bitwise_xor.reduce(cells["keys"][:2]) == np.bitwise_xor.reduce(keys[:2])


def expected(docs):
    """Rows equal in id and text have one place; others follow in descending ids."""
    places = list(dict.fromkeys(sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))))
    out = []
    for i, (doc_id, text) in enumerate(places):
        text, following = text or "", places[(i + 1) % len(places)][1] or ""
        new = edited(text, following)
        row = (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), alike(text, new), alike(text, following))
        out += [row] * docs.count((doc_id, places[i][1]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 150])
def test_like_brute_force(spark, n):
    r = random.Random(n)
    docs = [(r.randrange(10**6) * 10**6 + i, made(r, r.choice([0, 1, 3, 30, 200]))) for i in range(n)]
    docs += [(None, "last one. of all\nyes")] if n > 1 else []
    docs += [(5, None), (-7, "")] + [(10**14, "hot. row")] * 300 if n > 2 else []
    frame = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, slot int, near_next double").repartition(5)
    got = sketches.edits(frame, s=SMALL).withColumnRenamed("id", "doc_id")
    want = expected(docs)
    assert found(got) == want
    assert found(sketches.edits(frame).withColumnRenamed("id", "doc_id")) == want


def test_order_of_equal_ids(spark):
    frame = spark.createDataFrame([(i % 2, f"t{i}. u") for i in range(40)] + [(None, f"n{i}") for i in range(20)], "doc_id long, text string")
    got = sketches.edits(frame, s=SMALL).select("id", "edited_sha256").collect()
    order = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(order, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = [(o.doc_id, hashlib.sha256(edited(o.text, p.text).encode()).hexdigest()) for o, p in zip(order, order[1:] + order[:1])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_hot_key_gets_parts_of_its_own():
    cuts, parts = sketches._cuts([(0, i, 0) for i in range(8)] + [(0, 9, 4)] * 30 + [(0, i, 0) for i in range(20, 28)], 4)
    assert (0, 9, 4) in cuts and (0, 9, 5) in cuts and len(parts) == len(cuts) + 1
    assert parts[cuts.index((0, 9, 4)) + 1] > 4 and sum(p > 1 for p in parts) == 1


def test_query(spark, root):
    r = random.Random(5)
    docs = [(i, made(r, 40)) for i in range(60)] + [(100, "very long. " * 60_000), (101, "very long. " * 30_000 + "other end. " * 30_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    df = QUERIES["op11_fingerprints"](spark, root)
    assert df.columns[:2] == ["doc_id", "n_chars"]
    assert found(df) == expected(docs)


def test_empty_table(spark):
    assert sketches.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
