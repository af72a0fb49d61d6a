"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Fit: a bounded, hash-chosen sample of labelled rows, as many for each language, is dealt to a
fixed number of shards; each shard runs follow-the-regularised-leader with elastic-net penalties
over its rows, and the shards' weights are averaged. A temperature is then fitted to rows of the
sample that took no part in that. Only the sample's size and the fixed feature table bound what
the driver sees.

Prediction: every whole text, in Arrow batches; no shuffle.

Defined results: null, empty or letterless text, or no learned language: ``und`` with score 0.
Rows without a label or with a null id are not learned from. Repeated rows are predicted alike.
A frame without labelled rows gives a model without languages. Ties go to the language that sorts
first. Columns of the input that have the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covspark.llm.common import fresh, written

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Parameters; ``per_lang`` bounds the rows a language is learned from, ``max_langs`` the languages."""

    buckets: int = 1 << 14
    orders: tuple[int, ...] = (1, 2, 3)
    per_lang: int = 1200
    max_langs: int = 256
    shards: int = 8
    epochs: int = 2
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x langs
    bias: np.ndarray
    temperature: float = 1.0
    settings: Settings = field(default_factory=Settings)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, other runs as one space; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return codes[:0]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run that follows a letter
    return np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)]))


def counts(texts: list[str | None], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and which texts have a letter."""
    parts = [_codes(t) if t else np.zeros(0, np.uint32) for t in texts]
    size = np.array([len(p) for p in parts])
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), size)
    shift = np.uint64(64 - (settings.buckets.bit_length() - 1))
    out = np.zeros(len(parts) * settings.buckets, dtype=np.int64)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(settings.orders) + 1):
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        rolled = rolled[:m] * np.uint64(0x100000001B3) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in settings.orders:
            inside = owner[:m] == owner[n - 1 :]
            spot = ((rolled * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            out += np.bincount((owner[:m] * settings.buckets + spot)[inside], minlength=len(out))
    return out.reshape(len(parts), settings.buckets), size > 0


def _batches(rows: list, n: int = 64) -> Iterator[list]:
    for i in range(0, len(rows), n):
        yield rows[i : i + n]


def _texts(column: pa.Array, n: int = 64) -> Iterator[list[str | None]]:
    """A column's texts, a few at a time, so that a worker never holds a second copy of a batch."""
    for i in range(0, len(column), n):
        yield column.slice(i, n).to_pylist()


def _scaled(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf.astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _train(texts: list[str], labels: list[int], n_langs: int, idf: np.ndarray, s: Settings) -> np.ndarray:
    """FTRL-proximal over the rows in order; the last row of the result is the bias."""
    z = np.zeros((s.buckets + 1, n_langs))
    n = np.zeros_like(z)

    def weights(rows: np.ndarray) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= s.l1, 0.0, -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(nn)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at in _batches(list(range(len(texts)))):
            tf, _ = counts([texts[i] for i in at], s)
            for x, i in zip(_scaled(tf, idf), at, strict=True):
                used = np.append(np.flatnonzero(x), s.buckets)
                value = np.append(x[used[:-1]], 1.0)
                w = weights(used)
                wrong = _softmax(value @ w)
                wrong[labels[i]] -= 1.0
                g = value[:, None] * wrong
                sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / s.alpha
                z[used] += g - sigma * w
                n[used] += g * g
    return weights(np.arange(s.buckets + 1))


def sample(labelled: DataFrame, text: str, lang: str, s: Settings) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of the text: text, lang, shard, holdout."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(11), F.col(text)).alias("h")
    )
    rate = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.max_langs)
    unit = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    return (
        rows.join(rate, "lang")
        .where(unit < s.per_lang / F.col("n"))
        .select(
            "text",
            "lang",
            F.pmod(F.shiftright("h", 24), F.lit(s.shards)).cast("int").alias("shard"),
            (F.pmod(F.shiftright("h", 34), F.lit(4)) == 0).alias("holdout"),
            "h",
        )
    )


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """A model of the languages in ``lang``; the driver gets shards x buckets x languages numbers."""
    s = settings
    rows = written(sample(labelled, text, lang, s), "langid-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], np.ones(s.buckets, np.float32), np.zeros((s.buckets, 0)), np.zeros(0), settings=s)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(s.buckets, dtype=np.int64), 0
        for b in batches:
            for texts in _texts(b.column(0)):
                tf, _ = counts(texts, s)
                df += (tf > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tolist()]})

    found = rows.where(~F.col("holdout")).select("text").mapInArrow(frequencies, "n long, df array<long>").collect()
    n = sum(r.n for r in found)
    df = np.sum([r.df for r in found], axis=0) if found else np.zeros(s.buckets)
    idf = (1 + np.log((1 + n) / (1 + df))).astype(np.float32)
    place = {x: i for i, x in enumerate(langs)}

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "text"])
        w = _train(part["text"].tolist(), [place[x] for x in part["lang"]], len(langs), idf, s)
        return pd.DataFrame({"n": [len(part)], "w": [w.astype(np.float32).tobytes()]})

    trained = (
        rows.where(~F.col("holdout")).groupBy("shard").applyInPandas(shard, "n long, w binary").orderBy("n", "w").collect()
    )
    total = max(1, sum(r.n for r in trained))
    w = np.zeros((s.buckets + 1, len(langs)))
    for r in trained:
        w += np.frombuffer(r.w, np.float32).reshape(w.shape) * (r.n / total)
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1].astype(np.float32), 1.0, s)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [logits(texts, model)[0] for texts in _texts(b.column(0))]
            yield pa.RecordBatch.from_pydict({"z": np.concatenate(z).tolist() if z else [], "lang": b.column(1)})

    out = rows.where("holdout").select("text", "lang").mapInArrow(held, "z array<double>, lang string").collect()
    if not out:
        return model
    z, y = np.array([r.z for r in out]), np.array([place[r.lang] for r in out])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return Model(langs, idf, model.weights, model.bias, float(grid[int(np.argmin(loss))]), s)


def logits(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    tf, has = counts(texts, model.settings)
    return _scaled(tf, model.idf) @ model.weights + model.bias, has


def predict(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The frame with the predicted language and its calibrated probability."""
    rest = df.drop(*[c for c in df.columns if c in (pred, score) and c != text])
    names = rest.columns
    at = names.index(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    said = rest.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = said.value
        for b in batches:
            langs: list[str] = []
            scores: list[float] = []
            for texts in _texts(b.column(at)):
                if not m.langs:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                z, has = logits(texts, m)
                p = _softmax(z.astype(np.float64) / m.temperature)
                best = p.argmax(axis=1)
                langs += [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, has, strict=True)]
                scores += np.where(has, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, pred, score]
            )

    return rest.mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """The documents in a language, with their own columns; the model is learned from their labels.

    A text that has no letter goes, and one on whose best language less than ``least`` of the
    probability lies. Without any label only letterless texts go.
    """
    model = fit(docs, text, lang)
    if not model.langs:
        return docs.where(F.col(text).rlike("\\p{L}"))
    pred, score = fresh(docs, "_lang"), fresh(docs, "_lang_score")
    found = predict(docs, model, text, pred, score).where((F.col(pred) != UNKNOWN) & (F.col(score) >= least))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
