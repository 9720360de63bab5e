"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partitions are sized by the caller
# (cores locally; data size / ~128 MB on a cluster).  AQE re-plans joins at
# runtime, coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Every operator is also checked with ANSI mode on (tools/oracle_check.py);
    # our own sessions run without it for throughput.
    "spark.sql.ansi.enabled": "false",
    # No broadcast from plan-time estimates.  Explicit broadcasts sit behind a
    # size check (functions.joins.checked_broadcast_join) or a bound by
    # construction; AQE may still switch a join to broadcast from the
    # *measured* size of a finished shuffle stage.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "draftkit", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with ``DEFAULT_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must already be configured (a shared file system
    every executor sees).  Only a local-mode session without one (tests,
    benchmarks) gets a fresh private folder.  Works for classic sessions
    and, through the session conf, for Spark Connect sessions.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder before running")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if sc.master.startswith("local"):
        base = os.environ.get("TMPDIR", "/tmp")
        d = tempfile.mkdtemp(prefix="draftkit-ckpt-", dir=base)
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    raise RuntimeError(
        "spark.checkpoint.dir is not set: point it at a shared folder before running")


def materialize(df, name: str = "table"):
    """Write ``df`` as a parquet table in the shared checkpoint folder and
    read it back: the lineage is cut, the input is computed once (an eager
    ``checkpoint()`` computes it twice: one job to count, one to write), and
    later reads prune columns and push filters."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, remembered for
    ``remove_scratch``."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables that this process wrote to the checkpoint folder
    (call it when no result that reads them is needed any more); returns
    their number."""
    sc = spark.sparkContext
    n = 0
    while _SCRATCH:
        p = sc._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True))
    return n



def size_for_input(spark: SparkSession, input_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Size shuffles for an input of ``input_bytes``: about one shuffle
    partition per ``target_bytes`` (AQE coalesces small ones and splits
    skewed ones at run time), scan splits of the same size.  Returns the
    partition count that was set."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
            -(-input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return n


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``draftkit`` importable by the Python workers of this
    application (``SparkContext.addPyFile`` of a zip of the package, once per
    application) -- what ``--py-files`` does for spark-submit.  Pandas UDFs,
    grouped maps and streaming state functions refer to library functions
    that executors must import."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship with spark.addArtifacts
        return
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # staging file on the driver only; Spark copies it to every executor
    fd, path = tempfile.mkstemp(prefix="draftkit-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


#: Bounds of an Arrow batch (whole texts travel in them).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Ship the package to the Python workers and bound their batches: a
    worker holds a few MB of texts at a time, whatever their length."""
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
