import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covspark.llm import rtree

SMALL = rtree.Settings(positives=3, negatives=4, page=4, fan=3, slabs=3, sample=50, tree_rows=30, block=5)


def brute(rows, every, s):
    """Straight from the definition, row by row."""
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(256 * float(x))) for x in v], label))
    out = []
    for a, (anchor, q, own) in enumerate(good):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, label) for n, (i, v, label) in enumerate(good) if n != a]
        for neg, positive, _ in sorted(r for r in scored if r[2] == own)[: s.positives]:
            window = sorted(r for r in scored if r[2] != own and s.low * -neg <= 100 * -r[0] <= s.high * -neg)
            out += [(anchor, positive, n + 1, r[1], -neg, -r[0]) for n, r in enumerate(window[: s.negatives])]
    return sorted(out)


def run(spark, rows, s=SMALL, every=5):
    kind = "vec_id long, embedding array<double>, label int, anchor string, tree int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], kind).repartition(3)
    return sorted(tuple(r) for r in rtree.mine(df, F.col("label"), F.col("vec_id") % every == 0, s=s).collect())


@pytest.mark.parametrize("kind", ["spread", "clusters", "same", "hot label"])
def test_like_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n = 300
    if kind == "clusters":
        v = np.repeat(rng.normal(size=(6, 6)), 50, axis=0) + rng.normal(size=(n, 6)) * 0.1
    else:
        v = rng.normal(size=(n, 6)) + 0.5
    if kind == "same":
        v[:150] = v[0]
    labels = rng.integers(0, 4, n)
    if kind == "hot label":
        labels[:200] = 2
    rows = [(int(i), [float(np.float32(x)) for x in r], int(c)) for i, r, c in zip(rng.permutation(n), v, labels)]
    want = brute(rows, 5, SMALL)
    assert len(want) > 100
    assert run(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (1, [1.5], 1), (2, [0.4, 1.0], 2), (2, [0.4, 1.0], 2),
        (3, [0.5, 0.9, 0.1], 3), (4, None, 1), (10, [1.0, None], 2), (15, [float("nan"), 1.0], 2), (20, [float("inf"), 0.0], 1),
        (None, [1.0, 1.0], 1), (25, [1.0, 1.0], None), (30, [], 2), (35, [0.0, 0.0], 2), (40, [-1.0, -1.0], 1), (6, [-3.0, -3.0], 2),
    ]
    want = brute(rows, 5, SMALL)
    assert want and run(spark, rows) == want
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute([(0, [], 1), (1, [], 1), (2, [], 2)], 5, SMALL)


def test_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-2e5, 4e5) for _ in range(3)], i % 3) for i in range(60)]  # sums beyond 2^53
    want = brute(rows, 5, SMALL)
    assert want and run(spark, rows) == want
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        run(spark, [(0, [1e18], 1), (1, [1.0], 1)])
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(0, [8e6] * 3, 1), (1, [1.0], 1)])


def test_intervals_hold_every_product():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-50, 50, (40, 5)), rng.integers(-50, 50, (9, 5))
    low, high = rtree.intervals(q, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = q @ x.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (high[:, 0] >= scores.max(axis=1)).all()
    one = rtree.intervals(q, x[:1], x[:1])
    assert (one[0][:, 0] == scores[:, 0]).all() and (one[1][:, 0] == scores[:, 0]).all()


def test_queue_passes_boxes_over():
    x = np.array([[float(i), 1.0] for i in range(64)])
    s = rtree.Settings(page=4, fan=4)
    tree = rtree.Tree(np.arange(64), np.arange(64), np.zeros(64, int), x, s)
    q = np.array([[1.0, 0.0]])
    for low, high, kth in ((-rtree.OPEN, rtree.OPEN, [63, 62, 61]), (10, 20, [20, 19, 18]), (70, 80, [])):
        w = rtree.Windows(np.array([low]), np.array([high]), np.array([-rtree.OPEN]), 3)
        seen = []
        take = w.take
        w.take = lambda scores, ids, uid: (seen.append(len(ids)), take(scores, ids, uid))  # noqa: B023
        rtree._best_first(tree, tree.bounds(q), 0, -1, 0, q[0], True, w)
        assert [b[1] for b in w.best[0]] == kth and sum(seen) <= 12
