"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of 64-bit paragraph digests, the n-th copy of a paragraph counting as one of its
own. A paragraph is a stretch between line breaks, cut further behind sentence ends, so that a text
of one line has parts too. Every digest goes into one cell of each third of a sketch; a cell holds a
number, the xor of its digests and the xor of their checks. The fingerprint is the smallest sketch
(``cells``) with the number of digests, as text.

Two versions are compared by subtracting their cells: what they share cancels, and peeling cells
that hold a single digest recovers the digests of one side alone. Where cells are left over the
sketches were too small; they are made again with twice the cells and other places until nothing is
left. So the likeness, shared digests among all of both, is exact up to collisions of 64 bits.

``edits`` lines the documents up in descending order of their ids without one task seeing all of
them: cuts taken from a sample of ids deal the rows into slots, as in a sort, texts move once, and
each slot also gets the document that the next slot begins with. A (doc_id, text) that fills
several cuts by itself has a slot of its own and is spread over as many parts. The sample only says
where rows go; slots, and so the table of their first documents, are a few per shuffle partition or
one for ``slot_bytes`` of text.

Defined results: null texts are empty; a text without paragraphs has an empty sketch, and two of them
are alike (1.0), one of them and another text aren't (0.0). Documents of equal ids are ordered by a
64-bit hash of their texts, null ids come last. Rows equal in id and text share one place in the
order, so the next document is another one, and each keeps its row. A table with one document has it
as its own next one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.llm.common import written

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PARTS = re.compile(r"[^\n]*?[.!?](?=\s)|[^\n]+")


@dataclass(frozen=True)
class Settings:
    cells: int = 24  # of the fingerprint, a multiple of 3
    slot_bytes: int = 256 << 20
    samples: int = 24  # ids looked at for each cut
    chunk_chars: int = 2_000_000


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, PARTS.findall(text)) if p]


def digests(paragraph_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of every text, one text after the other, and where each text's begin."""
    sizes = np.array([len(p) for p in paragraph_lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter((xxhash.xxh3_64_intdigest(p) for ps in paragraph_lists for p in ps), np.uint64, int(starts[-1]))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    at = np.arange(len(flat))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    copy = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
    return _mixed(flat + copy.astype(np.uint64) * np.uint64(MIX[3]), 0), starts


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64 bits."""
    x = x ^ np.uint64((MIX[1] * (2 * salt + 1)) % 2**64)
    for shift, by in ((33, MIX[0]), (29, MIX[1]), (32, MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by | 1)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, size: np.ndarray, attempt: int) -> np.ndarray:
    """Three cells of each digest in a sketch of ``size`` cells, one in every third."""
    third = (size // 3).astype(np.uint64)
    return np.stack([(_mixed(keys, 8 * attempt + j + 1) % third + np.uint64(j) * third).astype(np.int64) for j in range(3)])


def _checks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 7) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Cells:
    """Sketches of several texts side by side."""

    number: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, n: int) -> Cells:
        return cls(np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32))

    def put(self, at: np.ndarray, keys: np.ndarray, by: np.ndarray | int) -> None:
        """Adds each digest to its cells, ``by`` times (1 or -1)."""
        checks, by = _checks(keys), np.broadcast_to(np.asarray(by, np.int32), keys.shape)
        for row in at:
            np.add.at(self.number, row, by)
            np.bitwise_xor.at(self.keys, row, keys)
            np.bitwise_xor.at(self.checks, row, checks)


def fingerprints(keys: np.ndarray, starts: np.ndarray, cells: int) -> list[str]:
    """Every text's smallest sketch as text: digests, then numbers, xors and checks of the cells."""
    sizes = np.diff(starts)
    n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    all_cells = Cells.empty(n * cells)
    all_cells.put(_places(keys, np.full(len(keys), cells), 0) + doc * cells, keys, 1)
    row = np.dtype([("number", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
    flat = np.zeros(n * cells, row)
    flat["number"], flat["keys"], flat["checks"] = all_cells.number, all_cells.keys, all_cells.checks
    raw, step = flat.tobytes(), cells * row.itemsize
    return [f"{k}:{base64.b64encode(raw[i * step : (i + 1) * step]).decode()}" for i, k in enumerate(sizes.tolist())]


def differences(
    keys: np.ndarray, starts: np.ndarray, pairs: np.ndarray, cells: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one text of a pair has: their pairs, digests and sides (1 or -1), and the cells each pair took.

    ``pairs`` holds two text numbers a row. Sketches start with ``cells`` cells and double for the
    pairs whose cells can't be peeled to the end.
    """
    sizes = np.diff(starts)
    want = np.abs(sizes[pairs[:, 0]] - sizes[pairs[:, 1]])
    # a difference is at least as large as that of the numbers: smaller sketches can't be peeled
    size = np.full(len(pairs), cells, np.int64)
    while (small := size < want).any():
        size[small] *= 2
    open_, attempt, out = np.arange(len(pairs)), 0, []
    while len(open_):
        base = np.concatenate([[0], np.cumsum(size[open_])])
        sketch = Cells.empty(int(base[-1]))
        for side, by in ((0, 1), (1, -1)):
            texts = pairs[open_, side]
            n = sizes[texts]
            own = np.repeat(np.arange(len(open_)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[texts], n)
            sketch.put(_places(keys[at], size[open_][own], attempt) + base[own], keys[at], by)
        found = _peel(sketch, base, size[open_], attempt)
        owner, got, sides = found
        left = np.logical_or.reduceat((sketch.number != 0) | (sketch.keys != 0) | (sketch.checks != 0), base[:-1])
        balance = np.zeros(len(open_), np.int64)
        np.add.at(balance, owner, sides)
        left |= balance != sizes[pairs[open_, 0]] - sizes[pairs[open_, 1]]
        good = ~left[owner]
        out.append((open_[owner[good]], got[good], sides[good]))
        open_ = open_[left]
        size[open_] *= 2
        attempt += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), size
    owner, got, sides = (np.concatenate(x) for x in zip(*out, strict=True))
    return owner, got, sides, size


def _peel(sketch: Cells, base: np.ndarray, size: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Takes single digests out of all sketches, round by round; what can't be peeled stays in the cells."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cells = np.flatnonzero(np.abs(sketch.number) == 1)
    rounds = 0
    while len(cells):
        keys = sketch.keys[cells]
        single = (np.abs(sketch.number[cells]) == 1) & (_checks(keys) == sketch.checks[cells])
        cells, keys = cells[single], keys[single]
        owner = np.searchsorted(base, cells, side="right") - 1
        # a digest may stand alone in several of its cells at once
        order = np.lexsort((keys, owner))
        owner, keys, cells = owner[order], keys[order], cells[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        owner, keys, sides = owner[first], keys[first], sketch.number[cells[first]].astype(np.int64)
        # more rounds than cells come only from chance agreements of checks, which go round in circles
        if not len(keys) or rounds > size.max():
            break
        at = _places(keys, size[owner], attempt) + base[owner]
        sketch.put(at, keys, -sides)
        found.append((owner, keys, sides))
        cells = np.unique(at)
        cells = cells[np.abs(sketch.number[cells]) == 1]
        rounds += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def likeness(keys: np.ndarray, starts: np.ndarray, pairs: np.ndarray, cells: int) -> np.ndarray:
    """Shared digests among all of both texts of each pair, from what subtraction and peeling recover."""
    owner, _, sides, _ = differences(keys, starts, pairs, cells)
    sizes = np.diff(starts)
    only = np.bincount(owner[sides > 0], minlength=len(pairs))
    other = np.bincount(owner[sides < 0], minlength=len(pairs))
    shared = sizes[pairs[:, 0]] - only
    union = shared + only + other
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


Key = tuple[int, int, int]
KEY = ("flag", "down", "tie")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text and the sort key of descending ids: nulls flagged, ids inverted, equal ids by the text's hash."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(
        "id",
        "text",
        F.col("id").isNull().cast("int").alias("flag"),
        F.coalesce(F.bitwise_not("id"), F.lit(0)).cast("long").alias("down"),
        F.xxhash64("text").alias("tie"),
    )


def _cuts(picked: list[Key], samples: int) -> tuple[list[Key], list[int]]:
    """Where slots begin, and the parts of each slot. A key that fills several cuts alone gets a slot with as many parts."""
    drawn = sorted(picked)[samples::samples]
    cuts: list[Key] = []
    parts = [1]
    i = 0
    while i < len(drawn):
        n = 1
        while i + n < len(drawn) and drawn[i + n] == drawn[i]:
            n += 1
        cuts.append(drawn[i])
        parts.append(n)
        if n > 1:
            flag, down, tie = drawn[i]
            cuts.append((flag, down, tie + 1))
            parts.append(1)
        i += n
    return cuts, parts


def dealt(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame | None:
    """slot, part, last, id, text and key: rows dealt into slots in order, with the document that follows a slot as
    its last row; None for an empty table."""
    spark = docs.sparkSession
    rows = _keyed(docs, doc_id, text)
    keys = written(rows.select(*KEY, F.octet_length("text").cast("long").alias("size")), "sort-keys")
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return None
    wanted = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // s.slot_bytes + 1)
    share = min(1.0, 2.0 * wanted * s.samples / n)
    picked = [tuple(r) for r in keys.select(*KEY).sample(share, seed=11).collect()]
    cuts, parts = _cuts(picked, max(len(picked) // wanted, 1))

    @F.pandas_udf("int")
    def slot(flag: pd.Series, down: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in zip(flag.tolist(), down.tolist(), tie.tolist(), strict=True)], dtype="int32")

    lowest = keys.withColumn("slot", slot(*KEY)).groupBy("slot").agg(F.min(F.struct(*KEY)).alias("low"))
    begins = {r.slot: tuple(r.low) for r in lowest.collect()}
    used = sorted(begins)
    # the document a slot begins with also ends the slot before it; the first of all ends the last slot
    ends = [(used[i - 1], p, *begins[used[i]]) for i in range(len(used)) for p in range(parts[used[i - 1]])]
    ends = spark.createDataFrame(ends, "slot int, part int, flag int, down long, tie long")
    firsts = spark.createDataFrame([begins[i] for i in used], "flag int, down long, tie long").distinct()
    texts = rows.join(F.broadcast(firsts), [*KEY]).groupBy(*KEY).agg(F.first("id").alias("id"), F.first("text").alias("text"))
    last = ends.join(texts, [*KEY]).select("slot", "part", F.lit(1).alias("last"), "id", "text", *KEY)
    spread = F.element_at(F.array(*map(F.lit, parts)), F.col("slot") + 1)
    part = F.pmod(F.monotonically_increasing_id(), spread).cast("int").alias("part")
    first = rows.withColumn("slot", slot(*KEY)).select("slot", part, F.lit(0).alias("last"), "id", "text", *KEY)
    return first.unionByName(last).repartition("slot", "part").sortWithinPartitions("slot", "part", "last", *KEY)


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, n_chars, n_paragraphs, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text."""
    out = (
        "id long, n_chars long, n_paragraphs long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    spark: SparkSession = docs.sparkSession
    stream = dealt(docs, doc_id, text, s)
    if stream is None:
        return spark.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, int, str]] = []  # id, text, copies, next text
        chars, place, now = 0, None, None
        for b in batches:
            for slot, part, last, i, t, *key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and place == (slot, part):
                    if not last and key == now[3]:
                        now[2] += 1
                        continue
                    held.append((now[0], now[1], now[2], t))
                    chars += len(now[1]) + len(t)
                    if chars > s.chunk_chars:
                        yield _compared(held, s)
                        held, chars = [], 0
                place, now = (slot, part), None if last else [i, t, 1, key]
        if held:
            yield _compared(held, s)

    return stream.mapInArrow(run, out)


def _compared(rows: list[tuple[int | None, str, int, str]], s: Settings) -> pa.RecordBatch:
    n = len(rows)
    ids, texts, copies, following = zip(*rows, strict=True)
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # a text's next one is mostly the following row
    numbers, lists = {}, []
    for t in (*texts, *following, *new):
        if t not in numbers:
            numbers[t] = len(lists)
            lists.append(paragraphs(t))
    own, nxt, ed = (np.array([numbers[t] for t in part]) for part in (texts, following, new))
    keys, starts = digests(lists)
    prints = fingerprints(keys, starts, s.cells)
    near = likeness(keys, starts, np.concatenate([np.stack([own, ed], 1), np.stack([own, nxt], 1)]), s.cells)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(np.diff(starts)[own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
        pa.array([prints[k] for k in own]),
        pa.array([prints[k] for k in ed]),
        pa.array(near[:n]),
        pa.array(near[n:]),
    ]
    names = ["id", "n_chars", "n_paragraphs", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    return batch if max(copies) == 1 else batch.take(pa.array(np.repeat(np.arange(n), copies)))
