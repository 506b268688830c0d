import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from brindle.plans import catalog
from tests.oracle import same_rows

SF = "/root/testdata/sf0.001"
SLOW = {"ml_gbt_fit", "ml_mlp_fit", "ml_importances"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_without_sql_returns_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """In a copy without the two folders, also with a leftover folder that has no module in it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = f"{tmp_path}/copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    shutil.copy(f"{root}/corpus_pipeline.py", copy) if os.path.exists(f"{root}/corpus_pipeline.py") else None
    program = "import __spark_entry__ as e; q = e.queries(); assert 'islands_runs' in q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    for leftover in (False, True):
        if leftover:
            os.makedirs(f"{copy}/brindle/llm/__pycache__")
        subprocess.run([sys.executable, "-c", program], cwd=copy, env={**os.environ, "PYTHONPATH": copy}, check=True, timeout=120)
