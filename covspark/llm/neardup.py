"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of its five-word shingles (lower case, words split at ASCII white
space): the number of times a shingle occurs, times 1 + log(N / df) / log(buckets). Document
frequencies are counted over all documents in a sketch with a fixed number of buckets, so the
weights' table has one size for any corpus, and a shingle counts as at least as frequent as its
bucket; the weight of the rarest is at most twice that of the commonest, so a group of very many
copies stays together.

Consistent weighted sampling draws ``rows`` x ``bands`` samples; two documents draw the same one
with a probability that is their weighted Jaccard similarity. Runs of ``rows`` samples are keys;
documents that share one are candidates (see ``candidates``, ``rest`` and, for keys of many classes, ``prefixed``), each pair is verified
by the weighted Jaccard similarity of the whole sets, and union-find over the verified links makes
the classes. Pairs that are in one class by other links aren't compared, all others that share a key are,
unless the weights in ``BINS`` ranges of shingles already show that they can't be similar enough.
Documents with the same words are one from the start, by a 64-bit hash of the words.

Defined results: a null text is in a class of its own; texts without words are copies of each other.
A text of fewer than five words is one shingle. Rows equal in id and text are one document. Of a class the smallest
(id, text hash) stays, null ids first. Long texts are sampled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.llm.candidates import by_weight, candidates, prefixed, rest
from covspark.llm.common import fresh, written
from covspark.llm.components import components

WORDS = 5
BASE = 0x9E3779B97F4A7C15 | 1
BINS = 64
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """At similarity 0.8 a pair shares a key with probability 0.995, at 0.9 with 0.99997.

    Classes of a key of at most ``few`` meet one by one, those of other keys by their documents' rarest shingles.
    """

    rows: int = 4
    bands: int = 10
    threshold: float = 0.8
    buckets: int = 1 << 16
    salts: int = 32
    few: int = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, from sums of powers over its bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U)
    up, down = _powers(max(1 << 17, 1 << int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)])))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles, each as often as it occurs."""
    w = word_hashes(text) if text else np.zeros(0, _U)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, _U)
    for k in range(min(WORDS, len(w))):
        h = _mix(h + w[k : k + n] * _U(2 * k + 1) + _U(k + 1))
    return np.sort(h)


def fingerprint(text: str) -> int:
    """A signed 64-bit hash of the words in order."""
    w = word_hashes(text)
    up, _ = _powers(max(1 << 17, 1 << int(len(w)).bit_length()))
    return int(_mix((_mix(w) * up[: len(w)]).sum(keepdims=True) + _U(len(w))).view(np.int64)[0])


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    return h[at], np.diff(np.append(at, len(h)))


def document_frequencies(texts: DataFrame, s: Settings) -> np.ndarray:
    """Weights by bucket, from the distinct shingles of every row of the one column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(s.buckets, np.int64), 0
        for b in batches:
            for i in range(b.num_rows):
                h, _ = counted(shingle_hashes(b.column(0)[i].as_py()))
                if len(h):
                    n += 1
                    np.add.at(df, (h % _U(s.buckets)).astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(s.buckets, np.int64)
        for x in part["df"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"n": [int(part["n"].sum())], "df": [total.tobytes()]})

    tasks = written(texts.mapInArrow(count, "n long, df binary").withColumn("g", (F.rand(1) * 64).cast("int")), "frequencies")
    # a row of fixed size for each task, summed in up to 64 groups, then here
    rows = tasks.groupBy("g").applyInPandas(add, "n long, df binary").collect()
    n = sum(r.n for r in rows)
    df = sum((np.frombuffer(r.df, np.int64) for r in rows), np.zeros(s.buckets, np.int64))
    rare = np.log(max(n, 1) / np.clip(df, 1, max(n, 1))) / np.log(s.buckets)
    return (1.0 + np.minimum(rare, 1.0)).astype(np.float32)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates r and logarithms of such, one for each 16-bit number."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    r = -np.log((1 - rng.random(1 << 16)) * (1 - rng.random(1 << 16)))
    c = -np.log((1 - rng.random(1 << 16)) * (1 - rng.random(1 << 16)))
    return np.maximum(r, 1e-4).astype(np.float32), np.log(np.maximum(c, 1e-9)).astype(np.float32)


def samples(hashes: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """ICWS sample ``k`` of each set (from each start on): a 32-bit name of the element and its level."""
    r_of, c_of = _draws()
    m = _mix(hashes + _U(0xD1342543DE82EF95 * (k + 1) & (1 << 64) - 1))
    r = r_of[(m & _U(0xFFFF)).astype(np.int64)]
    beta = ((m >> _U(32)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
    t = np.floor(log_weights / r + beta)
    a = c_of[((m >> _U(16)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta + np.float32(1))
    order = a.view(np.int32)
    order = (order ^ ((order >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
    name = (hashes + t.astype(np.int64).view(_U) * _U(BASE)) >> _U(32)
    return np.minimum.reduceat((order << 32) | name.view(np.int64), starts) & 0xFFFFFFFF


def signatures(sets: list[np.ndarray], weights: np.ndarray, s: Settings) -> np.ndarray:
    """The band keys of sorted shingle multisets, none of them empty."""
    parts = [counted(h) for h in sets]
    h = np.concatenate([p[0] for p in parts])
    lw = np.log(np.concatenate([p[1] for p in parts]) * weights[(h % _U(s.buckets)).astype(np.int64)]).astype(np.float32)
    starts = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    out = np.zeros((len(sets), s.bands), _U)
    for b in range(s.bands):
        for i in range(s.rows):
            out[:, b] = _mix(out[:, b] + samples(h, lw, starts, b * s.rows + i).astype(_U) + _U(1))
    return out.view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle multisets."""
    (a, n), (b, m) = counted(x), counted(y)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    idf = lambda h: weights[(h % _U(len(weights))).astype(np.int64)].astype(np.float64)
    shared = float((np.minimum(n[i], m[j]) * idf(both)).sum())
    total = float((n * idf(a)).sum() + (m * idf(b)).sum()) - shared
    return shared / total if total else 0.0


def _signed(docs: DataFrame, weights: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, text_hash, id (of the words, null for a null text) and keys (null without words)."""
    said = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int | None] = []
            keys: list[np.ndarray | None] = []
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def sign() -> None:
                if held:
                    for (i, _), row in zip(held, signatures([h for _, h in held], said.value, s), strict=True):
                        keys[i] = row

            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                h = shingle_hashes(text)
                ids.append(None if text is None else fingerprint(text))
                keys.append(None)
                if len(h):
                    held.append((i, h))
                    size += len(h)
                if size >= 1 << 15:
                    sign()
                    held, size = [], 0
            sign()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "id", "keys"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, id long, keys array<long>")


def profile(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of a shingle multiset in each of ``BINS`` ranges of hashes. The smaller sides of two sum up to what they share, or more."""
    w = weights[(h % _U(len(weights))).astype(np.int64)]
    return np.bincount((h >> _U(58)).astype(np.int64), w, BINS).astype(np.float32)


def within_reach(x: Column, y: Column, threshold: float) -> Column:
    """False for two profiles whose sets have a similarity below the threshold, whatever they share; float rounding is allowed for."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda n, v: n + v)
    shared = total(F.zip_with(x["profile"], y["profile"], lambda a, b: F.least(a, b)))
    return shared * (1 + threshold) * 1.0001 >= (x["weight"] + y["weight"]) * threshold


def _sets(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """id, shingles (sorted 64-bit hashes as binary), their profile and its sum."""
    said = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                sets = [shingle_hashes(t) for t in c.column(1).to_pylist()]
                bins = [profile(h, said.value) for h in sets]
                columns = [
                    c.column(0),
                    pa.array([h.tobytes() for h in sets], pa.binary()),
                    pa.array(bins, pa.list_(pa.float32())),
                    pa.array([float(p.sum(dtype=np.float64)) for p in bins], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "profile", "weight"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary, profile array<float>, weight double")


def _elements(sets: DataFrame, weights: np.ndarray) -> DataFrame:
    """id, name and weight of every distinct shingle of every set, written once."""
    said = sets.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, n = counted(np.frombuffer(b.column(1)[i].as_buffer(), _U))
                w = n * said.value[(h % _U(len(said.value))).astype(np.int64)].astype(np.float64)
                columns = [pa.array(np.full(len(h), b.column(0)[i].as_py())), pa.array(h.view(np.int64)), pa.array(w)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "name", "weight"])

    return written(sets.select("id", "shingles").mapInArrow(run, "id long, name long, weight double"), "elements")


def _compared(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The similarity of pairs (a, b, x, y): a, b, similarity."""
    said = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), _U) for c in (2, 3))
                out.append(similarity(x, y, said.value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, text_hash, class_id (the id of the class's first document), class_hash, kept and n_links for every row.

    ``n_links`` counts the verified links to documents with other words.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    weights = document_frequencies(rows.select("text"), s)
    signed = written(_signed(rows, weights, s), "signed")
    worded = signed.where(F.col("id").isNotNull())
    own = F.struct("doc_id", "text_hash")
    unique = written(worded.groupBy("id").agg(F.first("keys").alias("keys"), F.min(own).alias("first"), F.count("*").alias("n")), "unique")
    pairs, ranked = candidates(unique.select("id", "keys"), s.bands, s.salts, lags=3)
    pairs = written(pairs, "pairs")

    # every row of a shared key meets its centre, so these are all rows that a later pair can have
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(unique, "id")
    wanted = wanted.select("id", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("id", "text")
    sets = written(_sets(texts, weights).dropDuplicates(["id"]), "sets")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    tried = written(_compared(pairs.join(one, "a").join(two, "b"), weights), "near")
    reached = F.col("similarity") >= s.threshold
    links = tried.where(reached).select("a", "b")
    roots = written(components(links), "roots")
    held = unique.select("id", "keys").join(sets.select("id", "profile", "weight"), "id")
    near = lambda x, y: (
        (F.least(x["weight"], y["weight"]) * 1.0001 >= F.greatest(x["weight"], y["weight"]) * s.threshold) & within_reach(x, y, s.threshold)
    )
    light, heavy = by_weight(ranked, roots, s.few)
    others = rest(light, held, tried, roots, s.bands, near)
    heavy = written(heavy, "heavy")
    if not heavy.isEmpty():
        met = prefixed(_elements(sets.join(heavy.select("id"), "id"), weights), heavy, s.threshold)
        for at, row in (("a", "x"), ("b", "y")):
            met = met.join(held.select(F.col("id").alias(at), F.struct("weight", "profile").alias(row)), at)
        met = met.where(near(F.col("x"), F.col("y"))).select("a", "b").join(tried, ["a", "b"], "left_anti")
        others = others.unionByName(met).distinct()
    others = written(others, "pairs")
    if not others.isEmpty():
        more = written(_compared(others.join(one, "a").join(two, "b"), weights), "near").where(reached).select("a", "b")
        links = links.unionByName(more)
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    shared = unique.select("id", "first", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    shared = shared.where((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "id"))
    best = shared.groupBy("root").agg(F.min("first").alias("best"))
    known = written(shared.select("id", "root", "n_links").join(best, "root").select("id", "best", "n_links"), "classes")
    return signed.drop("keys").join(known, "id", "left").select(
        "doc_id",
        "text_hash",
        F.coalesce("best", own).alias("best"),
        F.coalesce(F.col("best") == own, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    ).select("doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), F.col("best.text_hash").alias("class_hash"), "kept", "n_links")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One document of each class, with its own columns."""
    gone = classify(docs, doc_id, text, s).where(~F.col("kept"))
    d, h, key = (fresh(docs, x) for x in ("_doc", "_hash", "_key"))
    gone = gone.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    left = docs.withColumn(key, F.xxhash64(F.col(text)))
    left = left.join(gone, F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(key) == F.col(h)), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
