"""Write an intermediate result to the cluster's shared folder and read it back.

A written table survives the loss of executors and cuts the lineage; the folder is the one
the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    app = spark.conf.get("spark.app.id", "app")
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/ticketlens/{app}"
    # Only where driver and executors are one process can a folder of the driver's be shared.
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as parquet under the shared folder and return the read-back."""
    spark = df.sparkSession
    safe = re.sub(r"[^a-z0-9_]+", "_", label.lower())
    path = f"{shared_root(spark)}/{safe}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads; anything outside the shared folder stays."""
    for df in staged:
        files = df.inputFiles()
        if not files:
            continue
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
        if path.getParent().toUri().getPath() == root.toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
