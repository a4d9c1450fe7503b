"""The library stands without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "quillspan")):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                assert "llm" not in open(os.path.join(folder, f)).read(), f
