"""What a session needs before Python functions of this package run in it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A worker's memory follows the batch, not the partition.
BATCH = "4m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application; rows go to Python in batches of a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once and read it again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
