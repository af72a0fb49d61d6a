"""Settings the jobs rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE sizes partitions, picks broadcast sides by measured size and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # target size of merged shuffle partitions, and so of the files a publication writes
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
SHARED = "spark.checkpoint.dir"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared folder. Without one, local mode gets its own and a cluster is refused."""
    root = spark.conf.get(SHARED, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SHARED, root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
