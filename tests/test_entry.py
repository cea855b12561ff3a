import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_imports_without_the_text_operators(folder):
    """A copy without the optional subpackage still lists its own queries, with or without the pipeline module."""
    copy = os.path.join(folder, "copy")
    shutil.copytree(os.path.join(ROOT, "moltraj"), os.path.join(copy, "moltraj"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy)
    listing = "import __spark_entry__ as e; names = set(e.queries()); assert 'pipeline' not in names; assert set(e.oracle_sql()) <= names; print(len(names))"
    done = subprocess.run([sys.executable, "-c", listing], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 70
