"""Exact top-k inner-product search with a pivot-distance index.

Inner products become distances by one added coordinate, sqrt(M - |x|^2) with M the largest squared
norm (0 for a query), so a higher score is a smaller distance and the triangle
inequality holds. Pivots are fitted to a bounded sample. Every vector is keyed by its nearest pivot
and its distance to it; sorted by that key, the vectors are cut into annuli of at most ``block``
rows. A query first scores the sample, which bounds its k-th score from below; annuli whose
distances to their pivot differ from the query's by more than that radius hold no answer and are
not joined. The rest reach the query's task in the order of that difference; as the k-th score
rises, the radius shrinks, and annuli beyond it are passed over. All bounds are kept with ties and
rounding slack, so the answer is exact.

Queries meet annuli block by block (``query_block`` x ``block``); a task holds one query block and
streams its annuli, of which ``streams`` tasks share each query block's. Nothing goes to the driver
but the sample and the pivots, both of fixed size.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; every row counts by itself, as a query and as an answer, also where
it repeats another; rows with the query's id are never its answers; null ids take no part. Squared
norms from 2^53 on are scored in 64-bit integers without bounds; from 2^62 on scores could leave them,
and the search is refused with a ValueError. Ties go to the smaller id. Fewer rows than
k give fewer ranks. An empty table has no answers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.llm.common import written

SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    k: int = 20
    pivots: int = 32
    sample: int = 2048
    block: int = 2048
    query_block: int = 1024
    streams: int = 8


@dataclass(frozen=True)
class Space:
    """What a task needs to key vectors: dimension, M, the pivots and the sample with its ids."""

    dim: int
    largest: float
    pivots: np.ndarray  # dim + 1 coordinates
    sample: np.ndarray
    sample_ids: np.ndarray
    exact: type  # number type in which all inner products are exact

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1, keepdims=True), 0.0))])

    @staticmethod
    def asked(q: np.ndarray) -> np.ndarray:
        """A query's place: its added coordinate is 0."""
        return np.hstack([q, np.zeros((len(q), 1))])

    def radius(self, norms: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a vector has just this score with a query of this squared norm."""
        if self.exact is np.int64:  # doubles would round such scores, so nothing is ruled out
            return np.full(len(norms), np.inf)
        return np.sqrt(np.maximum(norms + self.largest - 2 * score, 0.0)) * (1 + SLACK) + SLACK


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From differences, since squares would cancel for near points and the bounds must hold."""
    out = np.empty((len(a), len(b)))
    for j, x in enumerate(b):
        d = a - x
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def scaled(vector: Column, by: float) -> Column:
    """floor(by * x) of every component as doubles; null if the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)) & x.isNotNull()
    return F.when(fine, F.transform(x, lambda c: F.floor(c * by).cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    at = np.cumsum(sizes) - sizes
    for i, (a, n) in enumerate(zip(at, sizes, strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def fit(vectors: DataFrame, s: Settings) -> Space | None:
    """Pivots by a few rounds of k-means over the rows of smallest hash."""
    dim, largest = vectors.agg(
        F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    ).first()
    if dim is None:
        return None
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).collect()
    sample = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        sample[i, : len(r.vec)] = r.vec
    if largest >= 2**62:
        raise ValueError("components are too large: inner products could leave 64-bit integers")
    exact = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    space = Space(dim, float(largest), np.zeros((0, dim + 1)), sample, np.array([r.vec_id for r in rows], np.int64), exact)
    x = space.lifted(sample)
    pivots = x[: s.pivots].copy()
    for _ in range(8):
        near = _distances(x, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (near == p).any():
                pivots[p] = x[near == p].mean(axis=0)
    return Space(dim, float(largest), pivots, sample, space.sample_ids, exact)


def keyed(vectors: DataFrame, space: Space) -> DataFrame:
    """vec_id, pivot, dist and vec as binary doubles, for every vector."""
    said = vectors.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = said.value
        for b in batches:
            x = _matrix(b.column(1), sp.dim)
            d = _distances(sp.lifted(x), sp.pivots)
            near = d.argmin(axis=1)
            rows = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(rows, pa.binary())],
                names=["vec_id", "pivot", "dist", "vec"],
            )

    return vectors.select("vec_id", "vec").mapInArrow(run, "vec_id long, pivot int, dist double, vec binary")


def _blocks(rows: DataFrame, size: int, by_pivot: bool) -> DataFrame:
    """Runs of at most ``size`` sorted rows (of one pivot): block, pivot, lo, hi, ids, vecs."""
    dealt = rows.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            ids, pivots, dists, vecs = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + n], pa.int64()),
                    pa.array([pivots[0]], pa.int32()),
                    pa.array([dists[0]], pa.float64()),
                    pa.array([dists[-1]], pa.float64()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([b"".join(vecs)], pa.binary()),
                ],
                names=["block", "pivot", "lo", "hi", "ids", "vecs"],
            )

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == size or by_pivot and row[1] != held[-1][1]):
                    yield block()
                    n, held = n + 1, []
                held.append(row)
        if held:
            yield block()

    return dealt.mapInArrow(run, "block long, pivot int, lo double, hi double, ids binary, vecs binary")


def _reach(blocks: DataFrame, space: Space, k: int) -> DataFrame:
    """For every query block its seed scores, and for every pivot the distances its answers can have."""
    said = blocks.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = said.value
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["vecs"]).reshape(len(ids), sp.dim)
                scores = np.where(ids[:, None] == sp.sample_ids, -np.inf, q @ sp.sample.T)
                seed = np.full(len(ids), -np.inf)
                if scores.shape[1] > k and sp.exact is not np.int64:
                    seed = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                reach = sp.radius((q * q).sum(axis=1), seed)
                d = _distances(sp.asked(q), sp.pivots)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["block"]], pa.int64()),
                        pa.array([r["ids"]], pa.binary()),
                        pa.array([r["vecs"]], pa.binary()),
                        pa.array([seed.tobytes()], pa.binary()),
                        pa.array([(d - reach[:, None]).min(axis=0).tolist()], pa.list_(pa.float64())),
                        pa.array([(d + reach[:, None]).max(axis=0).tolist()], pa.list_(pa.float64())),
                        pa.array([d.mean(axis=0).tolist()], pa.list_(pa.float64())),
                    ],
                    names=["q", "ids", "vecs", "seed", "low", "high", "mid"],
                )

    kinds = "q long, ids binary, vecs binary, seed binary, low array<double>, high array<double>, mid array<double>"
    return blocks.mapInArrow(run, kinds)


def _search(stream: DataFrame, space: Space, k: int) -> DataFrame:
    """Running top k over each sorted stream of a query block and its annuli."""
    said = stream.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = said.value
        now, state = None, None
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                if r["pivot"] is None:
                    if state is not None:
                        yield answers(now, state)
                    q = np.frombuffer(r["vecs"]).reshape(len(ids), sp.dim)
                    far = _distances(sp.asked(q), sp.pivots)
                    state = (ids, q.astype(sp.exact), (q * q).sum(axis=1), far, np.frombuffer(r["seed"]).copy(), [[] for _ in ids])
                    now = r["q"]
                    continue
                own, q, norms, far, least, best = state
                d = far[:, r["pivot"]]
                gap = np.maximum(np.maximum(r["lo"] - d, d - r["hi"]), 0.0)
                want = np.flatnonzero(gap <= sp.radius(norms, least))
                if not want.size:
                    continue
                x = np.frombuffer(r["vecs"]).reshape(len(ids), sp.dim).astype(sp.exact)
                scores = (q[want] @ x.T).astype(np.int64)
                good = (scores >= least[want, None]) & (own[want][:, None] != ids)
                for i in np.flatnonzero(good.any(axis=1)):
                    w = want[i]
                    at = np.flatnonzero(good[i])
                    found = scores[i, at]
                    if len(at) > k:
                        at = at[found >= -np.partition(-found, k - 1)[k - 1]]
                        found = scores[i, at]
                    merged = sorted(best[w] + list(zip((-found).tolist(), ids[at].tolist(), strict=True)))[:k]
                    best[w] = merged
                    if len(merged) == k:
                        least[w] = max(least[w], -merged[-1][0])
        if state is not None:
            yield answers(now, state)

    def answers(now: int, state: tuple) -> pa.RecordBatch:
        own, best = state[0], state[5]
        rows = [(now, i, o, v, int(-s)) for i, (o, found) in enumerate(zip(own.tolist(), best, strict=True)) for s, v in found]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["q", "i", "query_id", "vec_id", "score"])

    return stream.mapInArrow(run, "q long, i long, query_id long, vec_id long, score long")


def search(
    table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, s: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``s.k`` highest inner products; ``is_query`` is told from ``vec_id``."""
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("vec"))
    rows = written(rows.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    space = fit(rows, s)
    result = "query_id long, rank int, vec_id long, score long"
    if space is None:
        return spark.createDataFrame([], result)
    keys = written(keyed(rows, space), "keyed")
    blocks = written(_blocks(keys, s.block, True), "annuli")
    queries = written(_reach(_blocks(keys.where(is_query), s.query_block, False), space, s.k), "queries")

    reach = queries.select("q", F.posexplode(F.arrays_zip("low", "high", "mid")).alias("pivot", "x")).select("q", "pivot", "x.*")
    near = F.greatest(F.col("lo") - F.col("mid"), F.col("mid") - F.col("hi"), F.lit(0.0))
    pairs = (
        blocks.select("block", "pivot", "lo", "hi")
        .join(reach, "pivot")
        .where((F.col("lo") <= F.col("high")) & (F.col("hi") >= F.col("low")))
        .select("q", "block", near.alias("gap"))
    )
    stream_no = F.pmod(F.xxhash64("block"), F.lit(s.streams)).cast("int")
    annuli = pairs.join(blocks, "block").select(
        "q", stream_no.alias("stream"), "gap", "pivot", "lo", "hi", "ids", "vecs", F.lit(None).cast("binary").alias("seed")
    )
    heads = queries.select(
        "q",
        F.explode(F.sequence(F.lit(0), F.lit(s.streams - 1))).alias("stream"),
        F.lit(-1.0).alias("gap"),
        F.lit(None).cast("int").alias("pivot"),
        F.lit(0.0).alias("lo"),
        F.lit(0.0).alias("hi"),
        "ids",
        "vecs",
        "seed",
    )
    stream = heads.unionByName(annuli).repartition("q", "stream").sortWithinPartitions("q", "stream", "gap")
    order = Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id")
    found = _search(stream, space, s.k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return found.select("query_id", "rank", "vec_id", "score")
