import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from newsloom.plans import catalog
from tests.conftest import SF
from tests.oracle import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert_same(spark, catalog.queries()[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).collect()  # a count would prune the columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


ROOT = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left", ["nothing", "empty folder", "pipeline", "pipeline and empty folder"])
def test_library_without_the_training_data_operators(tmp_path, left):
    shutil.copytree(ROOT / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if "pipeline" in left and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if "empty folder" in left:
        (tmp_path / "newsloom" / "llm").mkdir()
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == sorted(catalog.queries())
