"""What the corpus operators share: tables, written intermediates, stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once below the cluster's shared folder: survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket4(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, modulo 4; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
