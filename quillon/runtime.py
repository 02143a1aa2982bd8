"""Session helpers: tables, shared scratch space and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path under the one that the cluster names in spark.checkpoint.dir.

    Where that is unset (tests, notebooks), the warehouse takes its place, which a cluster shares too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, wherever its file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this driver. Results that were not written elsewhere can't be read afterwards."""
    for path in list(_SCRATCH):
        remove(spark, path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes a small file to any file system; returns its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def stash(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = where or scratch_dir(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of rows that a Python worker gets at once: long texts come in small batches.
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver got it from, and bounds what they hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
