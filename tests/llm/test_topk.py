import numpy as np
import pytest
from pyspark.sql import functions as F

from covspark.llm import topk

SMALL = topk.Settings(k=5, pivots=4, sample=40, block=16, query_block=7, streams=3)


def brute(rows, k, every, scale=64.0):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for i, q in good:
        if i % every:
            continue
        scores = sorted((-int(sum(a * b for a, b in zip(q, x))), j) for j, x in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, s, every=3):
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, s=s).collect())


@pytest.mark.parametrize("kind", ["spread", "clusters", "same"])
def test_like_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "spread":
        v = rng.normal(size=(150, 8))
    elif kind == "clusters":
        v = np.repeat(rng.normal(size=(5, 8)) * 4, 30, axis=0) + rng.normal(size=(150, 8)) * 0.05
    else:
        v = np.vstack([np.tile(rng.normal(size=8), (100, 1)), rng.normal(size=(50, 8)) * 3])
    rows = [(int(i), [float(np.float32(x)) for x in r]) for i, r in zip(rng.permutation(150), v)]
    assert run(spark, rows, SMALL) == brute(rows, 5, 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (6, None), (9, [1.0, None]), (12, [float("nan"), 1.0]), (15, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (1, [2.0]), (2, []), (4, [-5.0, 0.5]), (18, [0.0, 0.0])]
    assert run(spark, rows, SMALL) == brute(rows, 5, 3)
    assert run(spark, [], SMALL) == []
    assert run(spark, [(0, [1.0])], SMALL) == []


def test_bounds_pass_annuli_over():
    space = topk.Space(2, 100.0, np.zeros((1, 3)), np.zeros((0, 2)), np.zeros(0, int), np.float64)
    x = np.array([[6.0, 8.0], [1.0, 0.0]])
    lifted = space.lifted(x)
    d = topk._distances(space.asked(x), lifted)[0, 1]
    assert np.isclose(space.radius(np.array([100.0]), np.array([6.0]))[0], d, rtol=1e-4)


def test_every_row_counts(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = run(spark, rows, SMALL)
    assert got == brute(rows, 5, 3)
    assert [r[2] for r in got if r[0] == 0] == [1, 1, 3, 3, 2]


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rng.normal(size=(60, 3)) * 6e6)]
    rows += [(60 + i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rng.normal(size=(20, 3)))]
    assert run(spark, rows, SMALL) == brute(rows, 5, 3)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(0, [1e18, 0.0]), (3, [1.0, 2.0])], SMALL)
