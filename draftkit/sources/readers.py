"""Readers: chat JSON, prepared samples, feature listings, benchmark JSON,
sweep CSV, counter text.  Every reader passes an explicit schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit import schemas
from draftkit.operators.normalize import typed_turn


# ------------------------------------------------------------------ S1
def read_conversations(spark: SparkSession, path: str, schema: T.StructType = schemas.JSON_CONVERSATION) -> DataFrame:
    """``.jsonl`` -> one object per line; ``.json`` -> a JSON array
    (``multiLine``).  Unparsable lines land in ``_corrupt_record``.  Lists of
    turns come out as ``RAW_TURN``: texts and lists of parts are told apart
    by their JSON type."""
    sch = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    r = spark.read.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if path.endswith(".json"):
        r = r.option("multiLine", True)
    elif not path.endswith(".jsonl"):
        raise ValueError(f"unsupported conversation file: {path}")
    typed = [f.name for f in schema.fields if f.dataType == T.ArrayType(schemas.JSON_TURN)]
    return r.json(path).withColumns({c: F.transform(c, typed_turn) for c in typed})


# ------------------------------------------------------------------ S2 / S3
@dataclass(frozen=True)
class DatasetConfig:
    """A named source: where it lives, an optional row filter (a Column,
    so it pushes down) and an optional ``DataFrame -> DataFrame`` normaliser."""
    name: str
    path: str
    split: str = "train"
    subset: str | None = None
    filter: Column | None = None
    normalize: object | None = None


@dataclass(frozen=True)
class PromptSource:
    """S3: where the prompt text of a regeneration source lives."""
    name: str
    prompt_field: str
    default_split: str = "train"
    subset: str | None = None


def load_dataset(spark: SparkSession, registry: dict, name: str) -> DataFrame:
    """Look up ``name``, read it, apply filter then normaliser."""
    if name not in registry:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(registry)}")
    cfg = registry[name]
    df = read_any(spark, cfg.path)
    if cfg.filter is not None:
        df = df.filter(cfg.filter)
    if cfg.normalize is not None:
        df = cfg.normalize(df)
    return df


def prompts_of(df: DataFrame, source: PromptSource) -> DataFrame:
    """S3: select the prompt field as ``prompt``."""
    return df.withColumn("prompt", F.col(source.prompt_field))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json") or path.endswith(".jsonl"):
        return read_conversations(spark, path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S5
def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared samples with their fixed schema."""
    return spark.read.schema(schemas.PREPARED).parquet(path)


# ------------------------------------------------------------------ S10 / S11
# Fixed value: the file names of extracted features.
FEATURE_NAME = r"^hs_(.+)\.safetensors$"


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """File listing through ``binaryFile`` with only ``path``,
    ``length`` selected (the content column is pruned, nothing is read)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(path).select("path", "length")


def feature_ids(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Integer ids from ``hs_{int}.safetensors`` names; other names
    ignored; distinct (sort with ``orderBy`` when order matters)."""
    base = F.regexp_extract(F.col(name_col), r"([^/]+)$", 1)
    stem = F.regexp_extract(base, FEATURE_NAME, 1)
    ids = F.when(stem.rlike(r"^[+-]?[0-9]+$"), stem.cast("bigint"))
    return names.select(ids.alias("idx")).filter(F.col("idx").isNotNull()).distinct()


# ------------------------------------------------------------------ S12
def sample_lengths(files: DataFrame, sidecar: DataFrame | None, compat: bool = False) -> DataFrame:
    """Exact lengths from a sidecar ``(file_id, length)`` when present,
    else ``ceil(size / size0 * len0)`` from the first file (smallest id),
    whose exact length ``len0`` must be known.

    ``files``: ``(file_id, size, len0_hint)`` where ``len0_hint`` is the
    loaded length of the first file.  ``compat=True`` keeps the reference's
    rule that one missing key sends *every* file to the estimate; the default
    falls back per file.
    """
    first = files.agg(F.min_by(F.struct(F.col("size").alias("s0"), F.col("len0_hint").alias("l0")), "file_id").alias("_f")).select("_f.s0", "_f.l0")
    d = files.crossJoin(F.broadcast(first))  # one row, found in the plan
    est = F.ceil(F.col("size") / F.col("s0").cast("double") * F.col("l0")).cast("bigint")
    if sidecar is None:
        return d.select("file_id", est.alias("length"), F.lit(False).alias("exact"))
    d = d.join(sidecar.select("file_id", F.col("length").alias("_ex")), "file_id", "left")
    use_est = F.col("_ex").isNull()
    if compat:  # one scalar: does any file lack a sidecar entry?
        gap = files.join(sidecar.select("file_id"), "file_id", "left_anti").agg((F.count(F.lit(1)) > 0).alias("_gap"))
        d, use_est = d.crossJoin(F.broadcast(gap)), F.col("_gap")
    return d.select("file_id", F.when(use_est, est).otherwise(F.col("_ex")).cast("bigint").alias("length"),
                    (~use_est).alias("exact"))


# ------------------------------------------------------------------ S13 - S17
def read_benchmark_docs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark result documents (``multiLine``), one row per file,
    with the source file for S16/E20."""
    d = spark.read.schema(schemas.BENCH_RESULT).option("multiLine", True).json(path)
    return d.select(F.input_file_name().alias("file"), "args", "benchmarks")


def read_benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark entry (``inline``) with its file and the
    run's data-file argument."""
    d = read_benchmark_docs(spark, path)
    return d.select("file", F.element_at("args.data_args", 1)["data_files"].alias("data_files"),
                    F.inline_outer("benchmarks"))


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sweep CSV with a header; numbers through ``try_cast`` (bad -> NULL)."""
    d = spark.read.option("header", True).csv(path)
    out = []
    for c in d.columns:
        if c in ("label", "subset", "strategy"):
            out.append(F.col(c))
        else:
            out.append(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c))
    return d.select(*out, F.input_file_name().alias("file"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the file extension; other suffixes raise."""
    if path.endswith(".csv"):
        return read_sweep_csv(spark, path)
    if path.endswith(".json"):
        return read_benchmark_json(spark, path)
    raise ValueError(f"unsupported results file {path}")


def read_labelled(spark: SparkSession, specs: list[str]) -> DataFrame:
    """``LABEL=PATH`` sources; several paths may share one label
    (repetitions are pooled)."""
    frames = []
    for spec in specs:
        if "=" not in spec:
            raise ValueError(f"expected LABEL=PATH, got {spec!r}")
        label, path = spec.split("=", 1)
        frames.append(read_results(spark, path).withColumn("label", F.lit(label)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path (local, HDFS,
    object stores alike); on sessions without JVM access, a listing probe."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except Exception:  # noqa: BLE001 - e.g. Spark Connect
        try:
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            return True
        except Exception:  # noqa: BLE001
            return False


def read_counter_text(spark: SparkSession, path: str) -> DataFrame:
    """Counter exposition text, one row per line; a missing file gives
    an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path)


# ------------------------------------------------------------------ S20
def flatten_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested struct columns -> flat ``a/b/c`` columns (schema walk on
    the driver; the data stays columnar)."""
    out = []

    def walk(dt, path):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f.dataType, path + [f.name])
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return df.select(*out)
