"""The entry module with and without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op1_') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tidewright", tmp_path / "tidewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    n, ops, covered = shown(tmp_path)
    assert int(n) > 80 and ops == "0" and covered == "True"


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/tidewright"):
        if "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(f"{folder}/{name}", encoding="utf-8").read()), name


def test_entry_with_the_pipeline_alone(tmp_path):
    shutil.copytree(f"{ROOT}/tidewright", tmp_path / "tidewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    assert shown(tmp_path)[1] == "0"


def test_entry_where_a_module_of_the_subpackage_is_missing(tmp_path):
    shutil.copytree(f"{ROOT}/tidewright", tmp_path / "tidewright", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('gone', name='xxhash')")
    n, ops, covered = shown(tmp_path)
    assert int(n) > 80 and ops == "0" and covered == "True"
