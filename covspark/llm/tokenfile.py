"""Token-id files: documents in ascending id order, their ids range-coded in blocks.

The rows are dealt by ranges of their id and sorted, so file order is id order. Each task cuts its
documents into segments of at least ``segment`` ids (a document is never cut); a segment is one
record of a file: its documents' ids and lengths, and its blocks, each an independently reset and
checksummed payload of ``rangecoder``. The files are Parquet folders in which the payloads are
binary values, so Spark's own committer writes them to any store and a lost task leaves nothing.
Reading decodes each record by itself; a damaged block fails.

Defined results: a null or empty text has its end id alone. Null ids come first; rows that share an
id are ordered by text and each is kept. An empty table gives no records. Ids of 65536 and more
can't be coded and fail. Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.llm import rangecoder
from covspark.llm.bytebpe import tokenizer

SEGMENT = 1024 * rangecoder.BLOCK


def write(
    docs: DataFrame, at: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT
) -> None:
    """Write the files of ``docs`` to the new folder ``at``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.asc("doc_id")).sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = f"part long, before long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, crcs array<long>, blocks array<binary>"
    to_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in to_arrow:
        raise TypeError(f"document ids of type {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def record() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            payloads, crcs = rangecoder.encode(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([names], pa.list_(to_arrow[kind])),
                    pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())),
                    pa.array([crcs], pa.list_(pa.int64())),
                    pa.array([payloads], pa.list_(pa.binary())),
                ],
                names=["part", "before", "n_tokens", "doc_ids", "doc_tokens", "crcs", "blocks"],
            )

        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                for name, ids in zip(b.column(0).to_pylist(), bpe.encode(b.column(1).to_pylist()), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment:
                        yield record()
                        before += size
                        names, held, size = [], [], 0
        if held:
            yield record()

    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian 32-bit) of each document in the files."""
    files = spark.read.parquet(at)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file: the ids in all files before it
    bases = (
        files.groupBy("part")
        .agg(F.sum("n_tokens").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                part, first, n, names, counts, crcs, blocks = (c[0] for c in one.columns)
                ids = rangecoder.decode(blocks.as_py(), crcs.as_py(), n.as_py()).astype("<u4")
                size = counts.values.to_numpy()
                upto = np.cumsum(size)
                raw = ids.tobytes()
                cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(upto.tolist(), size.tolist(), strict=True)]
                same = lambda x: pa.array(np.full(len(cut), x.as_py(), dtype=np.int64))
                out = [names.values, same(part), pa.array(first.as_py() + upto - size), pa.array(size), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "part", "at", "n_tokens", "ids"])

    rows = files.select("part", "before", "n_tokens", "doc_ids", "doc_tokens", "crcs", "blocks").mapInArrow(
        run, f"doc_id {kind}, part long, at long, n_tokens long, ids binary"
    )
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
