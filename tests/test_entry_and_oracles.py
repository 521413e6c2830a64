import duckdb
import pytest

import __spark_entry__ as E
from deluge.sources.tables import TABLES

from .conftest import SF001, SF01


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return _duck(SF001)


@pytest.fixture(scope="module")
def duck01():
    return _duck(SF01)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["change", "combined_flood", "pixels"]
    assert sum(r.pixels for r in rows) == 200


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _compare(spark, con, name, sf):
    from check_oracles import _norm
    got = E.queries()[name](spark, sf).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns), name

    def rows(df):
        return sorted(repr(tuple(_norm(v) for v in r)) for r in df[sorted(df.columns)].astype(object).where(
            df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want), name


#: Queries of optional parts of the repository bring their own tests.
NAMES = sorted(k for k in E.oracle_sql() if not k.startswith("op") and k != "pipeline")


#: Queries that fit a model: the smallest tables yield no samples, so these are compared at the next size.
FITTED = [n for n in ("balanced_forest", "holdout_report", "model_invariants", "score_job_columns", "train_job") if n in NAMES]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in FITTED])
def test_values_equal_the_oracle(spark, duck, name):
    _compare(spark, duck, name, SF001)


@pytest.mark.parametrize("name", FITTED)
def test_fitted_values_equal_the_oracle(spark, duck01, name):
    _compare(spark, duck01, name, SF01)


def test_an_empty_sample_is_refused(spark):
    """The smallest tables have no sample: training says so before it fits."""
    with pytest.raises(ValueError, match="two classes"):
        E.queries()["rf_scores"](spark, SF001)


def test_change_counts_regression_anchor(spark):
    """FIXTURES.md anchor at sf0.01 (change, flood, pixels)."""
    rows = {(r.change, r.combined_flood): r.pixels for r in E.queries()["change_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert rows[(None, None)] == 294 and rows[(2, 1)] == 338 and rows[(3, 0)] == 335 and rows[(0, 1)] == 93


def test_python_worker_path_runs_outside_the_repo(tmp_path):
    """The driver imports __spark_entry__ from elsewhere: Python workers must not need the package."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['connected_count'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
