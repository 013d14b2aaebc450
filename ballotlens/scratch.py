"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder is used
in local mode only; on a cluster the setting is required, as a machine-local folder would lose data
with its machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_used: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a slash at its end."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ballotlens-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/ballotlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, below a folder of this application."""
    folder = _folder(spark)
    if folder not in _used:
        _used.add(folder)
        atexit.register(drop_all, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read again: the lineage ends there.

    A lost executor costs no recomputation, since the table is in shared storage. Columns and their
    types stay as they are; an empty ``df`` gives an empty table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(spark: SparkSession, folder: str | None = None) -> None:
    """Deletes all intermediate tables of this application; results that were not yet collected or written are lost with them.

    Called when the driver ends. A long-running application may call it between queries, once a query's result is stored.
    """
    try:
        folder = folder or _folder(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # at the end of the driver the JVM may be gone already
        if folder and folder.startswith("file:"):
            shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
