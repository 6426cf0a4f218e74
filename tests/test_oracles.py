"""Every registered query against its DuckDB oracle (row count, columns,
order-insensitive values) on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL

SF = os.environ.get("QUARRY_TEST_SF", SF_SMALL)
Q = E.queries()
O = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(O))
def test_query_matches_oracle(spark, con, key):
    problems, _ = compare(Q[key](spark, SF), con, O[key])
    assert not problems, problems


def test_every_query_has_rows_or_oracle(spark):
    assert set(O) <= set(Q)
    assert Q["run_log"](spark, SF).count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["system", "query_type", "n_queries", "mrr_3", "mrr_20", "hits_1", "hits_10"]
    assert len(rows) >= 1


def test_oracle_loads_without_spark_jars(tmp_path):
    """The statements need neither a session nor the jars beside pyspark."""
    import subprocess
    import sys
    from conftest import ROOT
    (tmp_path / "pyspark_elsewhere").mkdir()
    code = ("import sys, pyspark; pyspark.__file__ = sys.argv[1] + '/pyspark_elsewhere/__init__.py'; "
            "import __spark_entry__ as e; o = e.oracle_sql(); assert len(o) > 80 and all(o.values())")
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=ROOT, check=True, timeout=120)


def test_stop_lists_are_the_public_ones(spark):
    from pyspark.ml.feature import StopWordsRemover
    from quarry.functions.stopwords import STOP_LISTS, stop_words
    want = {(lang, w) for lang, name in STOP_LISTS.items() for w in StopWordsRemover.loadDefaultStopWords(name) if w}
    assert set(stop_words()) == want
