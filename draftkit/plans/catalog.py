"""Registered queries: each wires operators to the test tables and carries the
equivalent DuckDB SQL (``None`` where SQL cannot express the operator; those
are checked by invariant tests instead).

Result conventions shared with the SQL side: integers are ``bigint``,
fractions are ``double`` rounded to 6 places, arrays are compared as joined
strings, every computed column is aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.plans.tables import table  # noqa: E402,F401  (re-exported)
from draftkit.session import ship_package  # noqa: E402

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        def run(spark, sf_dir):
            ship_package(spark)  # executors import draftkit for UDFs / grouped maps
            return finalize(fn(spark, sf_dir))
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def round6(c):
    """Round to 6 places with one IEEE formula that DuckDB evaluates the same
    way: ``floor(x * 1e6 * (1 + 1e-12) + 0.5) / 1e6``.  Engine ``round``
    functions differ on ties, and multithreaded sums differ in the last bit;
    the tiny common nudge moves exact ties (frequent for means of
    two-decimal values) far above that noise, so both sides agree."""
    return F.floor(c.cast("double") * F.lit(1000000.000001) + F.lit(0.5)) / F.lit(1e6)


def finalize(df: DataFrame) -> DataFrame:
    """Integers -> bigint, floats -> double (result convention)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Query modules register themselves on import.
from draftkit.plans import q_prepare, q_sample, q_shape, q_metrics, q_evals, q_pack, q_stream, q_more, q_extra  # noqa: E402,F401
