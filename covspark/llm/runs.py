"""Periodic runs of words, as maximal pairs of a text's LCP-interval tree.

A run is a stretch of words with smallest period q that is at least ``exponent`` periods and
``length`` words long and that no neighbouring word extends. Its start s and s + q are a maximal
pair: the words from both agree for l = length - q words, the words left of both differ and so do
those behind the agreement. The other way round, a pair at distance d whose agreement l is at least
(exponent - 1) * d is a run with period d or a divisor of it; nothing has to be extended.

The suffixes of all texts of a slice are sorted together by prefix doubling, only where groups are
still undecided; agreements of neighbours come from the same levels. Intervals are merged bottom up,
the smaller list of positions into the larger one. A node's list is in word order with each
position's left-word class beside it: occurrences of a repeat that are at most a third of its length
apart lie exactly one period apart, so of the larger list only the two neighbours of a position can
make a run with it, and they do if their left words differ. Pairs at multiples of the period end in
the same stretch and fall to the smallest period. Texts without a repeated n-gram of the least
agreement, and intervals whose closest positions are too far apart, hold no run and aren't sorted or
merged.

Each text is handled in one task, slices are bounded in characters, and nothing is shuffled.

Defined results: words are stretches without ASCII white space; null and empty texts have no words,
no runs and an empty collapsed text. The best run has the greatest exact length / period, then the
smallest start, then the smallest period. Repeated rows each keep their row, null ids stay null,
other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.llm.common import fresh

RUN = "struct<start:long,length:long,period:long>"
Run = tuple[int, int, int]  # start, length, period


@dataclass(frozen=True)
class Settings:
    length: int = 6
    exponent: int = 4
    slice_chars: int = 4_000_000

    @property
    def agreement(self) -> int:
        """The least agreement of any pair that makes a run."""
        return min(max((self.exponent - 1) * d, self.length - d) for d in range(1, self.length + 1))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words begin (one entry more than texts)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.filter(real), kept[ends]


def repeating(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the texts in which n words in a row occur twice; hash collisions can only add some."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    m = len(codes) - n + 1
    if m <= 1:
        return np.zeros(0, np.int64)
    h = doc[:m].astype(np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : m + j].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    inside = doc[:m] == doc[n - 1 :]
    h, doc = h[inside], doc[:m][inside]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return np.unique(doc[np.isin(h, twice)]) if len(twice) else np.zeros(0, np.int64)


def suffixes(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in an order that groups equal prefixes of suffixes within each text, and the agreement
    of each with the one before it (0 across texts)."""
    n = len(codes)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][doc]
    key = doc * (int(codes.max()) + 1) + codes
    slots, place, order, rank = np.arange(n), np.arange(n), np.empty(n, np.int64), np.empty(n, np.int32)
    levels: list[np.ndarray] = []
    while True:
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        order[slots] = place
        rank = rank.copy()
        rank[place] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        levels.append(rank)
        alone = first & np.concatenate([first[1:], [True]])
        slots, place = slots[~alone], place[~alone]
        if not len(slots):
            break
        ahead = place + (1 << (len(levels) - 1))
        within = ahead < end[place]
        key = rank[place].astype(np.int64) * (n + 1)
        key[within] += rank[ahead[within]] + 1
    agree = np.zeros(n, np.int64)
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, got = order[same - 1], order[same], np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        on = np.flatnonzero((x < end[a]) & (y < end[b]))
        got[on[levels[k][x[on]] == levels[k][y[on]]]] += 1 << k
    agree[same] = got
    return order, agree


def _merged(one: list[int], two: list[int], agree: int, left: list[int], s: Settings, found: dict) -> list[int]:
    """Both lists as one; runs of their pairs go to ``found`` under (start, end) with the smallest period."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    reach = agree // (s.exponent - 1)
    for p in small:
        at = bisect_left(large, p)
        for other in large[max(at - 1, 0) : at + 1]:
            lo, d = (p, other - p) if p < other else (other, p - other)
            if d <= reach and d + agree >= s.length and left[p] != left[other]:
                stretch = (lo, lo + d + agree)
                found[stretch] = min(d, found.get(stretch, d))
    if len(small) < 8:
        for p in small:
            insort(large, p)
        return large
    return sorted(large + small)


def _tree(places: list[int], agree: list[int], left: list[int], s: Settings, found: dict) -> None:
    """Bottom-up merges over one stretch of neighbouring suffixes; agree[0] isn't used."""
    lists, depths = [[places[0]]], []
    for p, depth in zip(places[1:] + [0], agree[1:] + [0], strict=True):
        while depths and depths[-1] >= depth:
            two, one = lists.pop(), lists.pop()
            lists.append(_merged(one, two, depths.pop(), left, s, found))
        lists.append([p])
        depths.append(depth)


def find(codes: np.ndarray, starts: np.ndarray, s: Settings = Settings()) -> dict[int, list[Run]]:
    """The runs of every text that has some, by start and period; positions count from the text's first word."""
    docs = repeating(codes, starts, s.agreement)
    if not len(docs):
        return {}
    sizes = (starts[1:] - starts[:-1])[docs]
    own = np.concatenate([[0], np.cumsum(sizes)])
    codes = codes[np.repeat(starts[docs] - own[:-1], sizes) + np.arange(own[-1])]
    order, agree = suffixes(codes, own)
    begins = np.flatnonzero((agree < s.agreement) & np.concatenate([agree[1:] >= s.agreement, [False]]))
    if not len(begins):
        return {}
    # slots of each stretch of neighbours that agree enough, in word order, for the closest pair
    deep = agree >= s.agreement
    deep[begins] = True
    slots = np.flatnonzero(deep)
    stretch = np.cumsum(np.isin(slots, begins)) - 1
    by = np.lexsort((order[slots], stretch))
    gap = np.diff(order[slots][by])
    gap[np.diff(stretch[by]) != 0] = len(codes)
    edges = np.searchsorted(stretch, np.arange(len(begins) + 1))
    closest = np.minimum.reduceat(np.append(gap, len(codes)), edges[:-1])
    # a stretch's last gap leads to the next one and is larger than any other
    deepest = np.maximum.reduceat(np.where(np.isin(slots, begins), 0, agree[slots]), edges[:-1])
    left = np.concatenate([[-1], codes[:-1]])
    left[own[:-1]] = -1
    left = left.tolist()
    out: dict[int, list[Run]] = {}
    for i in np.flatnonzero(closest * (s.exponent - 1) <= deepest):
        part = slots[edges[i] : edges[i + 1]]
        found: dict[tuple[int, int], int] = {}
        _tree(order[part].tolist(), agree[part].tolist(), left, s, found)
        if found:
            doc = int(np.searchsorted(own, part_start := order[part[0]], side="right")) - 1
            base = int(own[doc])
            assert base <= part_start
            held = out.setdefault(int(docs[doc]), [])
            held += [(a - base, b - a, q) for (a, b), q in found.items()]
    for doc, held in out.items():
        least: dict[tuple[int, int], int] = {}
        for a, n, q in held:
            least[a, n] = min(q, least.get((a, n), q))
        out[doc] = sorted(((a, n, q) for (a, n), q in least.items()), key=lambda r: (r[0], r[2]))
    return out


def best(runs: list[Run]) -> Run:
    """The run of greatest exact exponent; ties to the smaller start, then period."""
    return min(runs, key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]))


def _structs(runs: list[Run | None]) -> pa.StructArray:
    cols = [pa.array([None if r is None else r[i] for r in runs], pa.int64()) for i in range(3)]
    return pa.StructArray.from_arrays(cols, names=["start", "length", "period"], mask=pa.array([r is None for r in runs], pa.bool_()))


def _slice(ids: pa.Array, texts: pa.Array, s: Settings) -> pa.RecordBatch:
    words, starts = words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find(codes, starts, s)
    keep = np.ones(len(words), bool)
    for doc, held in runs.items():
        for a, n, q in held:
            keep[starts[doc] + a + q : starts[doc] + a + n] = False
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words if keep.all() else words.filter(pa.array(keep)))
    each = [runs.get(i, []) for i in range(len(ids))]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in each])])
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(starts)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs([r for held in each for r in held])),
            _structs([best(r) if r else None for r in each]),
            pc.binary_join(lists, " "),
        ],
        names=["id", "n_words", "runs", "best", "collapsed"],
    )


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """First and number of neighbouring rows whose sizes stay within the limit; a larger one goes alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > limit:
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes) - first


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", s: Settings = Settings()) -> DataFrame:
    """id, n_words, runs, best and collapsed (words a run doesn't repeat, joined by one space) of every text."""
    rows = docs.select(F.col(doc_id).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, n in slices(sizes, s.slice_chars):
                yield _slice(b.column(0).slice(first, n), b.column(1).slice(first, n), s)

    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def looped(text: Column, number: Column) -> Column:
    """The text's words with an end that goes round, as the checks plant it: where number % 10 = 0, word i >= a
    becomes word a + (i - a) % p, with g = number // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words).cast("long")
    g = F.floor(number / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), turns))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((number % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), F.array_join(made, " ")).otherwise(text)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of every document with its looped end: the number of runs, the best one, and digests of all runs and of the rest."""
    number = fresh(docs, "number")
    rows = docs.withColumn(number, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = scan(rows, text=looped(F.col("text"), F.col(number)), s=s)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
