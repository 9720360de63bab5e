"""Driver contract: entry runs, every query has a callable, oracle keys exist."""

import duckdb

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
FAST = ["N1_role_aliases", "T4_tokens_truncated", "R17_failure_runs", "M5_kl_div", "E4_acceptance_rates",
        "Q12_kept_lengths", "S20_flatten_metrics"]


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["draft_id", "target_id", "offset", "token", "freq"]


def test_registry_consistent():
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_fast_oracles_match(spark):
    con = duckdb.connect()
    for t in ["events", "documents", "embeddings", "labels", "conversations", "benchmark", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in FAST:
        a = queries()[name](spark, SF).toPandas()
        b = con.execute(oracle_sql()[name]).df()
        assert sorted(a.columns) == sorted(b.columns), name
        assert len(a) == len(b), name
        cols = sorted(a.columns)
        norm = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df[cols].itertuples(index=False))
        assert norm(a) == norm(b), name


def test_queries_run_from_another_directory(tmp_path):
    """Python workers import draftkit through the shipped package, not the
    working directory (a driver may run from anywhere)."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '/root/repo')\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print(E.queries()['U6_R18_bulk_call'](s, '/root/testdata/sf0.001').count())\n")
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert r.stdout.strip().splitlines()[-1] == "200"
