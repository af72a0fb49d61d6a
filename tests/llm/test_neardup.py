import random
from collections import Counter

import numpy as np
import pytest

from covspark.llm import neardup

S = neardup.Settings()


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    base = [text(rng.randint(80, 400)) for _ in range(25)]
    docs = []
    for i in range(150):
        kind, b = rng.random(), rng.choice(base).split()
        if kind < 0.3:
            docs.append((i, text(rng.randint(1, 200))))
        elif kind < 0.5:
            docs.append((i, text(100) + " " + passage + " " + text(60)))
        else:
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6, 20])):
                b[rng.randrange(len(b))] = rng.choice(vocabulary)
            docs.append((i, rng.choice([" ", "\n", "  "]).join(b).upper() if rng.random() < 0.2 else " ".join(b)))
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "One  two"), (None, base[0]), (5, docs[5][1]), (5, base[1]), (206, text(20000)), (207, "a b a b " * 50)]
    return docs


def weighted(docs):
    """Brute force: shingle multisets of words, frequencies by bucket as the operator defines them."""
    sets = []
    for _, t in docs:
        w = [x for x in (t or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    name = {}
    for s in sets:
        for sh in s:
            if sh not in name:
                name[sh] = int(neardup.shingle_hashes(" ".join(sh))[0])
    assert len(set(name.values())) == len(name)
    df = Counter(b for s in sets for b in [name[x] % S.buckets for x in s])
    n = sum(bool(s) for s in sets)
    idf = {x: 1 + min(1, np.log(n / min(max(df[h % S.buckets], 1), n)) / np.log(S.buckets)) for x, h in name.items()}
    return sets, idf


def jaccard(a, b, idf):
    top = sum(min(n, b[x]) * idf[x] for x, n in a.items())
    bottom = sum(max(a[x], b[x]) * idf[x] for x in a.keys() | b.keys())
    return top / bottom if bottom else 0.0


def test_classes_like_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, id string").repartition(6)
    got = neardup.classify(df).collect()
    assert len(got) == len(docs)
    sets, idf = weighted(docs)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if jaccard(sets[i], sets[j], idf) >= 0.8 or docs[i] == docs[j] or docs[i][1] is not None and docs[j][1] is not None and not sets[i] and not sets[j]:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    order = lambda d: -1 if d is None else d
    wanted = sorted((order(d), order(min(g, key=order))) for g in groups.values() for d in g)
    assert sum(len(g) > 1 for g in groups.values()) > 8
    assert sorted((order(r.doc_id), order(r.class_id)) for r in got) == wanted
    kept = {(r.class_id, r.class_hash) for r in got if r.kept}
    assert kept == {(r.class_id, r.class_hash) for r in got}
    left = neardup.keep(df)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got)


def test_samples_are_consistent():
    """Two sets draw the same sample about as often as their weighted similarity says."""
    rng = np.random.default_rng(3)
    for overlap in (100, 300, 380):
        a, b = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64)), None
        b = np.sort(np.concatenate((a[:overlap], rng.integers(0, 2**63, 400 - overlap).astype(np.uint64), a[:50])))
        w = (1 + rng.random(S.buckets)).astype(np.float32)
        same = 0
        for h in (a, b):
            assert (np.diff(h.astype(object)) >= 0).all()
        pa_, pb = neardup.counted(a), neardup.counted(b)
        for k in range(600):
            draw = [
                neardup.samples(h, np.log(n * w[(h % np.uint64(S.buckets)).astype(int)]).astype(np.float32), np.array([0]), k)[0]
                for h, n in (pa_, pb)
            ]
            same += draw[0] == draw[1]
        assert abs(same / 600 - neardup.similarity(a, b, w)) < 0.07


def test_hashes():
    assert neardup.fingerprint("a B\nc") == neardup.fingerprint(" A b  c ") != neardup.fingerprint("a c b")
    assert neardup.fingerprint(" \n") == neardup.fingerprint("") and len(neardup.shingle_hashes(None)) == 0
    words = [f"x{i}" for i in range(20000)]
    assert len(np.unique(neardup.word_hashes(" ".join(words)))) == 20000
    assert len(neardup.shingle_hashes("a b c d e f")) == 2 and len(neardup.shingle_hashes("a b")) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classify(df).count() == 0 and neardup.keep(df).count() == 0
