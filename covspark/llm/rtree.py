"""Hard negatives by window searches in an STR-packed R-tree over integer vectors.

Rows are sorted by tiles: label, then slabs of the two coordinates that vary most, then the third,
and cut where Spark cuts the sorted rows: one tree a partition, of about ``tree_rows`` rows. In a
task a tree's rows are packed into pages of ``page`` neighbours and pages into nodes of ``fan``
children, each with its minimum bounding box and label range. A box and an anchor give an interval
that holds every inner product, coordinate by coordinate: the sum of the larger of a * low and
a * high, and of the smaller one.

Each anchor keeps a queue of boxes, best upper bound first. A box is passed over if its interval
misses all score windows of the anchor, if it is strictly below the k-th score of every window it
meets (at equal scores a smaller id could still win), or if its labels can't be the wanted ones. The
boxes of whole trees are the top level, which every task knows: an anchor first visits the tree with
the best bound, then, with the k-th scores found there, the other trees that it can't rule out.
Anchors travel to trees, not trees to anchors; a task holds one tree and streams its anchors.

Positives are a search with one open window among rows of the anchor's label, negatives one with a
window a positive among rows of other labels.

Scores are exact: all arithmetic is in integers, or in doubles where every sum stays below 2^53.
The top level is held by every task: trees are made larger rather than more than ``top`` of them.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part; shorter vectors count as padded with zeros. Components that reach 2^31 when scaled, or a
vector whose squared length reaches 2^56, are refused with an error, as scores would leave 64 bits.
Every row counts, so a row's copy is another row; ties go to the smaller id. Anchors without positives,
and positives without rows in their window, have no rows; a negative positive score has an empty
window. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.llm.common import written

LARGEST = 2.0**56  # squared length; percentages of scores stay in 64 bits
OPEN = 2**62  # beyond every score


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of the positive's score
    high: int = 90
    page: int = 64
    fan: int = 16
    slabs: int = 8
    sample: int = 4096  # rows that slabs are taken from
    tree_rows: int = 131_072
    top: int = 65_536
    block: int = 256  # anchors that a task takes up together


def whole(vector: Column, by: int) -> Column:
    """floor(by * x) of every component as int; null if the vector takes no part, an error if it can't be held."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    small = F.forall(x, lambda c: F.abs(c * by) < 2.0**31 - 1)
    refused = F.raise_error(F.lit("a vector's component is too large for 64-bit scores")).cast("array<int>")
    return F.when(fine & small, F.transform(x, lambda c: F.floor(c * by).cast("int"))).when(fine, refused)


def vectors(table: DataFrame, vec_id: str, vector: str, label: Column, by: int) -> DataFrame:
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole(F.col(vector), by).alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())


@dataclass(frozen=True)
class Top:
    """The boxes of all trees, tree by tree, and the number type that holds every score."""

    dim: int
    exact: type
    trees: np.ndarray
    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each box."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def _tiles(rows: DataFrame, s: Settings) -> tuple[Column, Column, Column]:
    """Slab of the first coordinate, slab of the second within it, and the third, by a bounded sample of rows."""
    picked = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(s.sample).select("vec").collect()
    dim = max(len(r.vec) for r in picked)
    x = np.zeros((len(picked), dim), np.int64)
    for i, r in enumerate(picked):
        x[i, : len(r.vec)] = r.vec
    wide = np.argsort(-x.std(axis=0), kind="stable")[:3]
    at = [F.coalesce(F.get("vec", F.lit(int(d))), F.lit(0)) for d in wide] + [F.lit(0)] * (3 - len(wide))
    if len(wide) < 3:
        return at[0], at[1], at[2]
    cut = np.linspace(0, 1, s.slabs + 1)[1:-1]
    first = np.quantile(x[:, wide[0]], cut)
    slab = np.searchsorted(first, x[:, wide[0]], side="right")
    second = [np.quantile(x[slab == i, wide[1]], cut).tolist() if (slab == i).any() else [] for i in range(s.slabs)]

    def beyond(cuts: Column, value: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= value))

    one = beyond(F.array(*map(F.lit, first.tolist())), at[0])
    table = F.array(*[F.array(*map(F.lit, c)).cast("array<double>") for c in second])
    return one, beyond(F.element_at(table, one + 1), at[1]), at[2]


def pack(rows: DataFrame, s: Settings) -> tuple[DataFrame, Top] | None:
    """tree, uid, vec_id, label and vec of every row, and the boxes of the trees; None without rows."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, dim, largest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(square)).first()
    if not n:
        return None
    if largest >= LARGEST:
        raise ValueError(f"a vector's squared length is {largest:.3g}: scores need more than 64 bits")
    # a box's corner is longer than any vector in it
    exact = np.float64 if largest * max(dim, 1) < 2.0**53 else np.int64
    spark = rows.sparkSession
    # two trees a core keep all of them busy; very many rows make larger trees instead of a larger top level
    trees = min(max(2 * spark.sparkContext.defaultParallelism, n // s.tree_rows + 1), s.top, max(n // s.page, 1))
    one, two, three = _tiles(rows, s)
    sort = ["label", "_1", "_2", "_3", "vec_id"]
    tiled = rows.select("*", one.alias("_1"), two.alias("_2"), three.alias("_3"))
    dealt = tiled.repartitionByRange(trees, *sort).sortWithinPartitions(*sort)
    index = dealt.select(
        F.spark_partition_id().alias("tree"), F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vec"
    )
    index = written(index, "tree-rows")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, label, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)
            for t in np.unique(tree):
                own = tree == t
                edge = [x[own].min(axis=0), x[own].max(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t], pa.int32()),
                        *(pa.array([e.tolist()], pa.list_(pa.int32())) for e in edge),
                        *(pa.array([e], pa.int64()) for e in (label[own].min(), label[own].max())),
                    ],
                    names=["tree", "low", "high", "label_low", "label_high"],
                )

    kinds = "tree int, low array<int>, high array<int>, label_low long, label_high long"
    part = index.select("tree", "label", "vec").mapInArrow(boxes, kinds)
    def side(name: str, pick) -> Column:
        if not dim:
            return F.array().cast("array<int>")
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: pick(F.transform(name, lambda v: v[i])))

    # a batch of rows has one box a tree, so a tree's list is its rows by the Arrow batch size
    joined = part.groupBy("tree").agg(
        F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"),
        F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"),
    )
    found = joined.select("tree", side("lows", F.array_min).alias("low"), side("highs", F.array_max).alias("high"), "label_low", "label_high")
    found = found.orderBy("tree").collect()
    grid = lambda name: np.array([r[name] for r in found], exact).reshape(len(found), dim)
    return index, Top(
        dim, exact, np.array([r.tree for r in found]), grid("low"), grid("high"),
        np.array([r.label_low for r in found]), np.array([r.label_high for r in found]),
    )


class Tree:
    """One packed tree: rows in tile order, and level by level the boxes over them, pages first."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, s: Settings):
        self.uid, self.ids, self.labels, self.x, self.page = uid, ids, labels, x, s.page
        cuts = np.arange(0, len(ids), s.page)
        low, high = np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)
        least, most = np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts)
        self.levels = [(low, high, least, most)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), s.fan)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((low, high, least, most))
        self.fan = s.fan

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [intervals(anchors, low, high) for low, high, _, _ in self.levels]


class Windows:
    """The score windows of one anchor, each with its k best rows so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, seed: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.least = np.maximum(low, seed)  # scores below can't be answers
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in low]

    def wanted(self, low: float, high: float) -> bool:
        return bool(((high >= self.least) & (low <= self.high)).any())

    def take(self, scores: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        for w in np.flatnonzero((scores.max() >= self.least) & (scores.min() <= self.high)):
            at = np.flatnonzero((scores >= self.least[w]) & (scores <= self.high[w]))
            if len(at):
                new = zip((-scores[at]).astype(np.int64).tolist(), ids[at].tolist(), uid[at].tolist(), strict=True)
                self.best[w] = sorted([*self.best[w], *new])[: self.k]
                if len(self.best[w]) == self.k:
                    self.least[w] = max(self.least[w], -self.best[w][-1][0])


def _possible(least: np.ndarray, most: np.ndarray, label: int, same: bool) -> np.ndarray:
    """Boxes that can hold a row of the label, or of another one."""
    return (least <= label) & (label <= most) if same else (least != label) | (most != label)


def _best_first(tree: Tree, bounds: list, i: int, own: int, label: int, q: np.ndarray, same: bool, windows: Windows) -> None:
    """One anchor's queue over one tree."""
    able = [_possible(least, most, label, same) for _, _, least, most in tree.levels]
    queue = [(-bounds[-1][1][i, 0], len(tree.levels) - 1, 0)] if able[-1][0] else []
    while queue:
        most, level, at = heapq.heappop(queue)
        if -most < windows.least.min():
            return  # the boxes behind it are lower still
        if not windows.wanted(bounds[level][0][i, at], -most):
            continue
        if level:
            lows, highs = bounds[level - 1][0][i], bounds[level - 1][1][i]
            for c in range(at * tree.fan, min((at + 1) * tree.fan, len(highs))):
                if able[level - 1][c] and windows.wanted(lows[c], highs[c]):
                    heapq.heappush(queue, (-highs[c], level - 1, c))
            continue
        part = slice(at * tree.page, (at + 1) * tree.page)
        labels = tree.labels[part]
        good = ((labels == label) if same else (labels != label)) & (tree.uid[part] != own)
        if good.any():
            windows.take((tree.x[part] @ q)[good], tree.ids[part][good], tree.uid[part][good])


ANCHOR = "anchor long, label long, vec array<int>, keys array<long>, lows array<long>, highs array<long>, seeds array<long>"
ANSWER = "anchor long, window int, score long, vec_id long, uid long"


def _route(anchors: DataFrame, top: Top, same: bool, first: bool) -> DataFrame:
    """Anchors with the tree of the best bound, or with all other trees that they can't rule out."""
    said = anchors.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = said.value
        for whole_batch in batches:
            for begin in range(0, len(whole_batch), 256):
                b = whole_batch.slice(begin, 256)
                q = _matrix(b.column(2), t.dim).astype(t.exact)
                low, high = intervals(q, t.low, t.high)
                rows, trees = [], []
                for i, r in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 4, 5, 6)), strict=True)):
                    label, lows, highs, seeds = r
                    able = _possible(t.label_low, t.label_high, label, same)
                    if not able.any():
                        continue
                    home = int(np.where(able, high[i].astype(np.float64), -np.inf).argmax())
                    if first:
                        chosen = [home]
                    else:
                        least = np.maximum(np.array(lows), np.array(seeds))
                        able &= ((high[i][:, None] >= least) & (low[i][:, None] <= np.array(highs))).any(axis=1)
                        able[home] = False
                        chosen = np.flatnonzero(able).tolist()
                    rows += [i] * len(chosen)
                    trees += t.trees[chosen].tolist()
                moved = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), *moved.columns], names=["tree", *moved.schema.names])

    return anchors.mapInArrow(run, "tree int, " + ANCHOR)


def _visit(index: DataFrame, asked: DataFrame, top: Top, same: bool, k: int, s: Settings) -> DataFrame:
    """Each anchor's k best rows a window in each tree it is asked at."""
    none = lambda *names: [F.lit(None).cast("array<long>").alias(c) for c in names]
    rows = index.select("tree", F.lit(0).alias("kind"), "uid", "vec_id", "label", "vec", *none("lows", "highs", "seeds"))
    queries = asked.select(
        "tree", F.lit(1).alias("kind"), F.col("anchor").alias("uid"), F.lit(None).cast("long").alias("vec_id"),
        "label", "vec", "lows", "highs", "seeds",
    )
    dim, exact = top.dim, top.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for b in batches:
            trees, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(trees) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if trees[lo] != now:
                    now, held, tree = trees[lo], [], None
                x = _matrix(part.column(5), dim)
                if kinds[lo] == 0:
                    held.append((*(part.column(c).to_numpy() for c in (2, 3, 4)), x))
                    continue
                if tree is None:
                    uid, ids, labels, rows_of = (np.concatenate(c) for c in zip(*held, strict=True))
                    tree, held = Tree(uid, ids, labels, rows_of.astype(exact), s), []
                for begin in range(0, hi - lo, s.block):
                    yield answers(tree, part.slice(begin, s.block), x[begin : begin + s.block].astype(exact))

    def answers(tree: Tree, part: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        bounds, out = tree.bounds(q), []
        for i, (own, label, *limits) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 4, 6, 7, 8)), strict=True)):
            windows = Windows(*(np.array(x, np.int64) for x in limits), k)
            _best_first(tree, bounds, i, own, label, q[i], same, windows)
            out += [(own, w, -neg, v, u) for w, best in enumerate(windows.best) for neg, v, u in best]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "window", "score", "vec_id", "uid"])

    stream = rows.unionByName(queries).repartition("tree").sortWithinPartitions("tree", "kind", "uid")
    return stream.mapInArrow(run, ANSWER)


def search(index: DataFrame, top: Top, anchors: DataFrame, same: bool, k: int, s: Settings) -> DataFrame:
    """anchor, window, rank, score, vec_id, uid: the k best rows in every window of every anchor.

    ``anchors`` has anchor (its uid), label, vec, and per window the lists keys, lows and highs (inclusive).
    """
    nothing = F.transform("lows", lambda _: F.lit(-OPEN).cast("long"))
    anchors = anchors.select("anchor", "label", "vec", "keys", "lows", "highs", nothing.alias("seeds"))
    near = written(_visit(index, _route(anchors, top, same, True), top, same, k, s), "near-answers")
    kth = near.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("kth"))
    seeds = F.transform("lows", lambda _, i: F.coalesce(F.element_at("kth", i), F.lit(-OPEN)).cast("long"))
    known = anchors.drop("seeds").join(kth, "anchor", "left").withColumn("seeds", seeds).drop("kth")
    far = _visit(index, _route(known, top, same, False), top, same, k, s)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor", "window", "rank", "score", "vec_id", "uid")


def mine(
    table: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", by: int = 256, s: Settings = Settings()
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    ``label`` is a column of the table; ``is_anchor`` is told from ``vec_id``.
    """
    spark: SparkSession = table.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    packed = pack(written(vectors(table, vec_id, vector, label, by), "vectors"), s)
    if packed is None:
        return spark.createDataFrame([], out)
    index, top = packed
    chosen = index.where(is_anchor).select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec")
    edge = lambda x: F.array(F.lit(x).cast("long"))
    opened = chosen.select("anchor", "label", "vec", edge(0).alias("keys"), edge(-OPEN).alias("lows"), edge(OPEN).alias("highs"))
    positives = written(search(index, top, opened, True, s.positives, s), "positives")

    # smallest and greatest negative score of a positive: 100 * n >= low * p and 100 * n <= high * p
    least = F.expr(f"({s.low} * score) div 100 + CAST(({s.low} * score) % 100 > 0 AS LONG)")
    most = F.expr(f"({s.high} * score) div 100 - CAST(({s.high} * score) % 100 < 0 AS LONG)")
    each = F.struct("rank", "uid", least.alias("low"), most.alias("high"))
    lists = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(each)).alias("p"))
    asked = chosen.join(lists, "anchor").select(
        "anchor", "label", "vec", F.col("p.uid").alias("keys"), F.col("p.low").alias("lows"), F.col("p.high").alias("highs")
    )
    negatives = search(index, top, asked, False, s.negatives, s)
    names = chosen.select("anchor", "anchor_id")
    pairs = positives.join(names, "anchor").select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score"
    )
