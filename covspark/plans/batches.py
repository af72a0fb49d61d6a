"""Checkpoint batches: a batch closes once it holds enough items or enough bytes.

By count alone the batch number follows from the position. With bytes every batch start
depends on the one before. To stay parallel, items are cut into fixed chunks. A batch that
is open at a chunk's start began at most ``items - 1`` items earlier, so each chunk is first
summarised for all those starts at once, the summaries are chained per group, and each chunk
then numbers its own items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.operators import ordered

# The default batch limits.
MAX_ITEMS = 64
MAX_BYTES = 256 * 1024 * 1024
CHUNK = 65_536
FAN = 256
LEVELS = 3  # of nodes: FAN ** LEVELS chunks a group


def by_count(
    items: DataFrame, keys: list[str], order: list[str], bucket: Column, n: int = MAX_ITEMS
) -> DataFrame:
    """Adds ``batch`` (0-based) per group; n items close a batch."""
    placed = ordered.position(items, keys, order, bucket, "_position")
    return placed.withColumn(
        "batch", F.floor((F.col("_position") - 1) / n).cast("bigint")
    ).drop("_position")


def _ends(sizes: np.ndarray, n: int, limit: int) -> np.ndarray:
    """For a batch opened at each item, the item after its last one.

    The closing item is the first to reach either limit; an open batch ends past the data.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(total, total[:-1] + limit, side="left")
    return np.minimum(np.arange(len(sizes)) + n, full)


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equal or both null."""
    return left.join(right, [left[k].eqNullSafe(right[k]) for k in on]).drop(*[right[k] for k in on])


def bad_sizes(items: DataFrame, size: str) -> DataFrame:
    """Items that ``by_size`` refuses: a null or negative size says nothing about the batch's end."""
    return items.where(F.col(size).isNull() | (F.col(size) < 0))


def by_size(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    size: str,
    n: int = MAX_ITEMS,
    limit: int = MAX_BYTES,
    chunk: int = CHUNK,
) -> DataFrame:
    """Adds ``batch``: closes at n items or when the sizes reach ``limit``, checked after
    each item, so an oversized item ends its batch. ``order`` must be unique in a group. A null
    key is a group like any other; a null or negative size fails the job (see ``bad_sizes``)."""
    if n < 1 or chunk < n:
        raise ValueError("need n >= 1 and chunk >= n")
    placed = ordered.position(items, keys, order, bucket, "_position")
    number_of = F.floor((F.col("_position") - 1) / chunk)
    # the last n-1 items of a chunk also travel to the next one
    near_end = F.pmod(F.col("_position") - 1, F.lit(chunk)) >= chunk - (n - 1)
    both = F.when(near_end, F.array(number_of, number_of + 1)).otherwise(F.array(number_of))
    checked = F.when(F.col(size) >= 0, F.col(size).cast("bigint")).otherwise(
        F.raise_error(F.lit("a batch item has a null or negative size")).cast("bigint")
    )
    spread = placed.withColumn("_size", checked).select("*", F.explode(both).alias("_chunk"))
    spread = spread.withColumn("_tail", F.col("_chunk") != number_of)
    ddl = lambda names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in names)
    lead = f"{ddl(keys)}, " if keys else ""

    def read(part: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """The chunk in order, for a batch opened at each item the item after its last, and the tail's length."""
        part = part.sort_by("_position")
        return part, _ends(part["_size"].to_numpy(), n, limit), int(np.count_nonzero(part["_tail"].to_numpy()))

    def summarise(part: pa.Table) -> pa.Table:
        part, ends, tail = read(part)
        at = tail - np.minimum(np.arange(n), tail)
        closed = np.zeros(n, dtype=np.int64)
        stop = len(part)
        while tail < stop:
            nxt = ends[np.minimum(at, stop - 1)]
            done = (at < stop) & (nxt <= stop)
            if not done.any():
                break
            at = np.where(done, nxt, at)
            closed += done
        one = part.slice(0, int(tail < stop)).select([*keys, "_chunk"])
        lists = pa.list_(pa.int64())
        for name, value in (("_open", stop - at), ("_closed", closed)):
            one = one.append_column(name, pa.array([value.tolist()][: len(one)], lists))
        return one

    cells = spread.select(*keys, "_position", "_chunk", "_tail", "_size")
    maps = cells.groupBy(*keys, "_chunk").applyInArrow(
        summarise, f"{lead}_chunk bigint, _open array<bigint>, _closed array<bigint>"
    )
    states = _states(maps, keys, n)
    payload = items.columns

    def number(part: pa.Table) -> pa.Table:
        part, ends, tail = read(part)
        batch = np.zeros(len(part), dtype=np.int64)
        at, current = tail - part["_carried"][0].as_py(), part["_base"][0].as_py()
        while at < len(part):
            nxt = min(int(ends[at]), len(part))
            batch[at:nxt] = current
            at, current = nxt, current + 1
        return part.select(payload).append_column("batch", pa.array(batch)).slice(tail)

    joined = _join(spread, states, [*keys, "_chunk"])
    return joined.groupBy(*keys, "_chunk").applyInArrow(number, f"{ddl(payload)}, batch bigint")


def _nodes(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The maps of each parent in order: keys, _node, _maps."""
    each = F.struct("_chunk", "_open", "_closed")
    node = F.floor(F.col("_chunk") / FAN).alias("_node")
    return maps.groupBy(*keys, node).agg(F.sort_array(F.collect_list(each)).alias("_maps"))


def _states(maps: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, _chunk, _carried, _base: items of the open batch and batches closed before each chunk."""
    levels = [maps]
    longs = lambda c: c.cast("array<bigint>")
    start = F.struct(longs(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"), longs(F.array_repeat(F.lit(0), n)).alias("c"))

    def compose(f: Column, g: Column) -> Column:
        behind = lambda name, o: F.get(g[name], o.cast("int"))
        return F.struct(
            F.transform(f["o"], lambda o: behind("_open", o)).alias("o"),
            F.zip_with(f["c"], f["o"], lambda c, o: c + behind("_closed", o)).alias("c"),
        )

    for _ in range(LEVELS - 1):
        whole = _nodes(levels[-1], keys).withColumn("_m", F.aggregate("_maps", start, compose))
        levels.append(whole.select(*keys, F.col("_node").alias("_chunk"), F.col("_m.o").alias("_open"), F.col("_m.c").alias("_closed")))

    zero = F.lit(0).cast("bigint")
    state = lambda carried, base: F.struct(carried.alias("_carried"), base.alias("_base"))

    def step(acc: Column, g: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        at = last["_carried"].cast("int")
        return F.concat(acc, F.array(state(F.get(g["_open"], at), last["_base"] + F.get(g["_closed"], at))))

    # the top node begins with nothing open and nothing closed
    known = None
    for level in reversed(levels):
        nodes = _nodes(level, keys)
        if known is None:
            begun = nodes.withColumn("_carried", zero).withColumn("_base", zero)
        else:
            begun = _join(nodes, known.withColumnRenamed("_chunk", "_node"), [*keys, "_node"])
        began = F.aggregate("_maps", F.array(state(F.col("_carried"), F.col("_base"))), step)
        pairs = begun.select(*keys, F.explode(F.arrays_zip(F.col("_maps._chunk").alias("_chunk"), began.alias("_state"))).alias("_p"))
        # one state more than maps: that behind the last
        known = pairs.where("_p._chunk IS NOT NULL").select(*keys, "_p._chunk", "_p._state._carried", "_p._state._base")
    return known
