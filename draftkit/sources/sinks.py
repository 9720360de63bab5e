"""Writers.  "Skip if present" is decided by the ``_SUCCESS`` marker of a
finished Spark write, never by globbing for partial files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftkit import schemas
from draftkit.sources.commits import _fs, append_run, committed
from draftkit.sources.readers import path_exists


def _exists(spark: SparkSession, path: str) -> bool:
    """A finished Spark write leaves ``_SUCCESS``."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def write_prepared(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write prepared samples; a finished output is kept unless
    ``overwrite``.  Returns whether anything was written."""
    if not overwrite and _exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def append_jsonl(df: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append response rows (good and failed alike) as JSON lines.
    With ``run_id`` a run that is made again adds nothing (``read_jsonl_runs``
    reads them back).  Returns whether anything was written."""
    if run_id is not None:
        return append_run(df, path, run_id, lambda d, folder: d.write.json(folder))
    df.write.mode("append").json(path)
    return True


def read_jsonl_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed runs."""
    folders = list(committed(spark, path).values())
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def write_token_frequency(df: DataFrame, path: str) -> bool:
    """Token frequencies; a finished file is left alone."""
    if _exists(df.sparkSession, path):
        return False
    df.select("token_id", "freq").write.mode("overwrite").parquet(path)
    return True


def write_vocab_maps(d2t: DataFrame, t2d: DataFrame, path: str) -> None:
    """Both maps as parquet tables under one folder.  The marks of an
    older pair go first and each map's own comes last, so what has both marks
    is one pair, also where a write was cut short."""
    spark, path = d2t.sparkSession, path.rstrip("/")
    fs, to = _fs(spark, path)
    for name in ("t2d", "d2t"):
        fs.delete(to(f"{path}/{name}/_SUCCESS"), False)
    d2t.write.mode("overwrite").parquet(path + "/d2t")
    t2d.write.mode("overwrite").parquet(path + "/t2d")


def read_vocab_maps(spark: SparkSession, path: str):
    """Load ``(d2t, t2d)``; half a pair is an error."""
    path = path.rstrip("/")
    for name in ("d2t", "t2d"):
        if not _exists(spark, f"{path}/{name}"):
            raise FileNotFoundError(f"no finished {name} under {path}")
    return spark.read.parquet(path + "/d2t"), spark.read.parquet(path + "/t2d")


def append_csv(df: DataFrame, path: str, columns: list[str] = schemas.SWEEP_COLUMNS, run_id: str | None = None) -> bool:
    """Append rows with a fixed column list (extra keys ignored, missing
    ones NULL); every part file carries its header.  With ``run_id`` a run
    that is made again adds nothing (``committed`` names the runs' folders).
    Returns whether anything was written."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows = df.select(*cols)
    if run_id is not None:
        return append_run(rows, path, run_id, lambda d, folder: d.write.option("header", True).csv(folder))
    rows.write.mode("append").option("header", True).csv(path)
    return True


def max_tokens_document(df: DataFrame, subset_col: str = "subset", value_col: str = "max_tokens") -> DataFrame:
    """One row holding ``{subset: max_tokens}`` as a JSON object, keys
    in sorted order (one entry per subset, so the collected list is small)."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col(subset_col), F.col(value_col)))))).alias("max_tokens_json"))
