"""Registered queries of the engine against DuckDB over the small tables."""

import os

import duckdb
import pytest

from rillset.plans import queries as Q

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents labels".split()
# a query of each rule here; all are held against DuckDB by the driver
SOME = ["filter_compound_null", "agg_retract", "agg_rollup", "join_left", "win_range_rolling", "except_", "view_three_layer", "udaf_weighted_sum", "udtf_then_sql", "bitemporal_view", "order_limit_topk", "stream_foreach_batch", "step_delta_output"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got, want = Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    ours = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    theirs = sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
    assert ours == theirs


def test_entry_without_the_corpus_folder(tmp_path):
    """The driver's entry imports and keeps the engine's queries where the corpus subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rillset", tmp_path / "rillset", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_retract' in q and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
