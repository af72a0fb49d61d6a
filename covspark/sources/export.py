"""Export of query results: CSV, Parquet, Arrow IPC and JSON lines, one part per task."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMATS = ("csv", "parquet", "arrow", "jsonl")
BATCH_ROWS = 65_536


@dataclass(frozen=True)
class ExportResult:
    path: str
    rows: int
    publication_id: str | None


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _ArrowWriter(DataSourceArrowWriter):
    """Writes each task's batches to a hidden file and shows all files on commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (
            fs.LocalFileSystem(), self.path
        )

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        files, root = self._open()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}.arrow"
        hidden = f"{root}/_tmp-{self.run}-{context.taskAttemptId()}-{name}"
        files.create_dir(root, recursive=True)
        rows, writer = 0, None
        with files.open_output_stream(hidden) as sink:
            for batch in batches:
                if writer is None:
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer is not None:
                writer.close()
        if writer is None:
            files.delete_file(hidden)
            hidden = ""
        return _Part(hidden, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        files, root = self._open()
        parts = [m for m in messages if m is not None and m.name]
        fresh = set()
        for part in parts:
            shown = f"{root}/part-{part.name.split('-part-', 1)[1]}"
            files.move(part.name, shown)
            fresh.add(shown.rsplit("/", 1)[1])
        if self.overwrite:
            from pyarrow import fs

            for info in files.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-") and info.base_name not in fresh:
                    files.delete_file(info.path)
        with files.open_output_stream(f"{root}/_SUCCESS") as done:
            done.write(b"")

    def abort(self, messages: list[_Part | None]) -> None:
        files, _ = self._open()
        for part in messages:
            if part is not None and part.name:
                files.delete_file(part.name)


class ArrowIpcSink(DataSource):
    """``df.write.format("arrow_ipc").save(path)``: one Arrow file per task."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrowWriter(self.options["path"], overwrite)


def write(
    df: DataFrame,
    path: str,
    output_format: str,
    force: bool = False,
    publication_id: str | None = None,
) -> ExportResult:
    """Write a result and report its row count. Without ``force`` an existing target fails."""
    if output_format not in FORMATS:
        raise ValueError(f"unsupported export format {output_format!r}")
    jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if files.exists(jvm_path) and not force:
        raise FileExistsError(f"{path} exists; use force to replace it")
    if jvm_path.getParent() is not None and not files.exists(jvm_path.getParent()):
        raise FileNotFoundError(f"parent folder of {path} does not exist")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite" if force else "errorifexists")
    if output_format == "csv":
        writer.option("header", True).csv(path)
    elif output_format == "parquet":
        writer.parquet(path)
    elif output_format == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        df.sparkSession.dataSource.register(ArrowIpcSink)
        counted.write.mode("overwrite" if force else "append").format("arrow_ipc").save(path)
    return ExportResult(path, seen.get["rows"], publication_id)


def query_result(dataset, path: str, output_format: str, force: bool = False, **view) -> ExportResult:
    """Download of a data view: key order, strict coverage when keys and a range are named."""
    from covspark.operators.query import data_view_arguments

    df = dataset.query(**data_view_arguments(dataset.spec, **view))
    return write(df, path, output_format, force, dataset.manifest.publication_id)


def for_each_batch(
    df: DataFrame,
    consume: Callable[[pa.RecordBatch], int],
    batch_size: int = BATCH_ROWS,
) -> DataFrame:
    """Run ``consume`` on executors over Arrow batches of at most ``batch_size`` rows.

    Gives (partition, batches, rows, result), one row per task; result sums what
    ``consume`` returned.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = rows = result = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                piece = batch.slice(at, batch_size)
                result += consume(piece)
                count += 1
                rows += piece.num_rows
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"partition": [part], "batches": [count], "rows": [rows], "result": [result]}
        )

    return df.mapInArrow(run, "partition bigint, batches bigint, rows bigint, result bigint")


def read_arrow(spark, path: str, schema) -> DataFrame:
    """Arrow IPC part files back to rows, one task per file."""
    names = [f"{path}/{name}" for name in _part_names(spark, path)]
    if not names:
        return spark.createDataFrame([], schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, name = (
                    fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
                )
                with files.open_input_file(name) as source, pa.ipc.open_file(source) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    listing = spark.createDataFrame([(n,) for n in names], "path string").repartition(
        len(names), "path"
    )
    return listing.mapInArrow(load, schema)


def _part_names(spark, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n for n in names if n.startswith("part-"))
