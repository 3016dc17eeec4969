import os
import shutil
import subprocess
import sys

import pytest

from silkgraph.plans.oracle import ORACLES
from silkgraph.plans.queries import QUERIES
from tests.helpers import SMALL, assert_same

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LAYERED = {"gen_planted", "gen_small_world", "gen_clique", "gen_features", "logreg_predict", "sgd_predict", "zscore_sgd_predict"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == LAYERED
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_rest_works_without_the_pipeline_operators(tmp_path):
    """Both folders gone, with and without the pipeline's file."""
    for keep in (True, False):
        copy = tmp_path / str(keep)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if keep else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "[]"], out.stderr[-2000:]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["len", "path"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_logistic_regression_learns(spark):
    pred = QUERIES["logreg_predict"](spark, SMALL)
    assert pred.columns == ["row_id", "pred"]
    assert {r["pred"] for r in pred.collect()} <= {0, 1}
