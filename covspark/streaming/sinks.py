"""Result tables of streams.

``write_batches`` keeps one folder per micro-batch, so a repeated batch overwrites itself.
``upsert_batches`` keeps the current row of every key: rows lie in hash buckets, a batch rewrites
only the buckets it touches, and a read opens each bucket once however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "_batch"
BUCKET = "_bucket"
BUCKETS = 64


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger
) -> StreamingQuery:
    """Start a stream whose changed rows land in ``path/_batch=<id>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return _start(stream, save, checkpoint, mode, trigger)


def _start(stream: DataFrame, save: Callable, checkpoint: str, mode: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """Current row of every key of ``write_batches``: the one from the newest batch that changed it."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    body = F.struct(*[c for c in rows.columns if c not in (*keys, BATCH)])
    newest = rows.groupBy(*keys).agg(F.max_by(body, F.col(BATCH)).alias("_row"))
    return newest.select(*keys, "_row.*")


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``upsert_batches``; empty before the first batch."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    try:
        return spark.read.schema(full).parquet(path).drop(BUCKET)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _staged(spark: SparkSession, slot: str, batch_id: int) -> bool:
    """Whether the slot holds this batch as a whole."""
    try:
        spark.read.text(f"{slot}/_SUCCESS")
        return not spark.read.parquet(slot).where(F.col(BATCH) == batch_id).limit(1).isEmpty()
    except AnalysisException:
        return False


def upsert(
    batch: DataFrame,
    batch_id: int,
    path: str,
    keys: Sequence[str],
    merge: dict[str, Callable[[str], Column]] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Bring a batch's rows into the table, reading and writing only the buckets of its keys.

    A key's new row replaces the old one, or each column is combined by ``merge``, whose aggregates
    must not mind a row that comes twice. Touched buckets are first written whole next to the table
    and then moved in; a batch that is repeated after a failure in between moves the same rows in
    again. ``buckets`` stays fixed for a table's life.
    """
    spark = batch.sparkSession
    schema = batch.schema
    slot = f"{path}/_staged/{batch_id % 2}"
    if not _staged(spark, slot, batch_id):
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.withColumn(BUCKET, bucket).persist(StorageLevel.DISK_ONLY)
        try:
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            held = current(spark, path, schema).withColumn(BUCKET, F.lit(None).cast("int"))
            if not held.isEmpty():
                full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
                held = spark.read.schema(full).parquet(path).where(F.col(BUCKET).isin(touched))
            rows = held.withColumn(BATCH, F.lit(-1)).unionByName(new.withColumn(BATCH, F.lit(batch_id)))
            body = [c for c in schema.names if c not in keys]
            if merge:
                kept = rows.groupBy(*keys, BUCKET).agg(*[merge[c](c).alias(c) for c in body])
            else:
                newest = F.max_by(F.struct(*body), F.col(BATCH)).alias("_row")
                kept = rows.groupBy(*keys, BUCKET).agg(newest).select(*keys, BUCKET, "_row.*")
            staged = kept.select(*schema.names, BUCKET, F.lit(batch_id).alias(BATCH))
            staged.repartition(BUCKET).write.mode("overwrite").parquet(slot)
        finally:
            new.unpersist()
    moved = spark.read.parquet(slot).drop(BATCH).repartition(BUCKET)
    moved.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    merge: dict[str, Callable[[str], Column]] | None = None,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Start a stream into a table of current rows (see ``upsert``).

    With ``merge`` the table is the state: the stream itself keeps none, and ``prepare`` reduces
    each batch to rows of the table.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert(prepare(batch) if prepare else batch, batch_id, path, keys, merge, buckets)

    return _start(stream, save, checkpoint, "append" if prepare else "update", trigger)
