"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{ROOT}/corpuswell", tmp_path / "corpuswell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        n, numbered, piped = done.stdout.split()
        assert int(n) > 40 and (numbered, piped) == ("False", "False")
