"""Packing by concatenation and cutting.

Pass 1 tokenizes every partition and writes its documents' ids, each with the number of ids before
it in its partition. Pass 2 sums the partitions' totals, one row a partition, into their global
offsets; every document then knows its place in the one long stream, which fixed windows cut. A
window that spans documents, or two partitions, is made of several boundary records (pieces), so
nothing is shuffled: no id moves between tasks. Only the last sequence is padded.

Defined results: a null or empty text is its end id alone. Repeated rows are each packed. The order
is that in which Spark reads the rows. An empty table has no pieces. Columns beside id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.llm.bytebpe import tokenizer
from covspark.session import shared_folder

WINDOW = 2048


def tokenized(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, before, doc_tokens and ids (binary), written to the shared folder."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [x + end for x in bpe.encode(b.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.full(len(ids), part, dtype=np.int64)),
                        pa.array(before + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )
                before += int(n.sum())

    out = rows.mapInArrow(run, f"doc_id {kind}, part long, before long, doc_tokens long, ids binary")
    at = shared_folder(docs.sparkSession, "tokens")
    out.write.option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.schema(out.schema).parquet(at)


def offsets(tokens: DataFrame) -> DataFrame:
    """part and the ids in all parts before it; one row for each partition of the tokenizing pass."""
    total = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece."""
    placed = tokens.join(F.broadcast(offsets(tokens)), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at")
    )
    w, at, n = F.lit(window).cast("long"), F.col("at"), F.col("doc_tokens")

    def cut(s):
        first = F.greatest(at, s * w)
        start, length = first - at, F.least(at + n, (s + 1) * w) - first
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
            s.alias("sequence_id"),
            (first - s * w).alias("offset"),
        )

    spans = F.sequence(F.floor(at / w), F.floor((at + n - 1) / w))
    return placed.select("doc_id", "doc_tokens", F.explode(F.transform(spans, cut)).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"
    )


def sequences(packed: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """sequence_id, ids (binary, padded to ``window``): at most ``window`` pieces meet in a group."""
    pad = F.unhex(F.lit(np.array([pad_id], dtype="<u4").tobytes().hex()))
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    short = F.lit(window) - (F.octet_length(joined) / 4).cast("int")
    padding = F.aggregate(F.array_repeat(pad, short), F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", F.concat(joined, padding).alias("ids"))


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    return pieces(tokenized(docs, path, end_id), window)
