"""Appends that a rerun does not double.

A run writes its rows to a folder of its own and then commits it: one small
file under ``_commits``, named by the run's id, says which folder it is.
Readers take committed folders only.  A run that is made again after its
commit writes nothing; one that was cut short before it has left a folder
that no one reads.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DIR = "_commits"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Run id -> folder of the committed runs (one entry a run)."""
    path = path.rstrip("/")
    fs, to = _fs(spark, path)
    if not fs.exists(to(f"{path}/{_DIR}")):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(to(f"{path}/{_DIR}")))
    return {n.rsplit("@", 1)[0]: f"{path}/run={n.rsplit('@', 1)[0]}/{n.rsplit('@', 1)[1]}" for n in names if "@" in n and not n.startswith(".")}


def append_run(df: DataFrame, path: str, run_id: str, write: Callable[[DataFrame, str], None]) -> bool:
    """``write(df, folder)`` once for this run id; whether it was written
    now.  The commit is the creation of one file."""
    if not run_id or any(c in run_id for c in "/@:") or run_id.startswith((".", "_")):
        raise ValueError(f"not a run id: {run_id!r}")
    spark, path = df.sparkSession, path.rstrip("/")
    if run_id in committed(spark, path):
        return False
    attempt = uuid.uuid4().hex + posixpath.splitext(path)[1]  # readers go by the ending
    write(df, f"{path}/run={run_id}/{attempt}")
    fs, to = _fs(spark, path)
    fs.mkdirs(to(f"{path}/{_DIR}"))
    if run_id in committed(spark, path):  # another writer of the same run was faster
        return False
    fs.create(to(f"{path}/{_DIR}/{run_id}@{attempt}"), False).close()
    return True
