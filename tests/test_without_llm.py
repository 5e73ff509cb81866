"""The rest works without the subpackage for text corpora."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_imports_and_answers(tmp_path, pipeline):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", "*.jsonl"))
    if not pipeline and (here / "corpus_pipeline.py").exists():
        (here / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_q1' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) == set(q); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, env=os.environ | {"PYTHONPATH": str(here)}, timeout=120)
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "example_similarity or lookup or tree_numbers", "-p", "no:cacheprovider"], cwd=here, env=os.environ | {"PYTHONPATH": str(here)}, capture_output=True, text=True, timeout=400)
    assert ran.returncode == 0, ran.stdout[-2000:]
