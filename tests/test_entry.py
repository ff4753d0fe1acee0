import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "spanforge"):
        (shutil.copytree if os.path.isdir(os.path.join(ROOT, name)) else shutil.copy)(os.path.join(ROOT, name), tmp_path / name)
    shutil.rmtree(tmp_path / "spanforge" / "llm", ignore_errors=True)
    assert "span_phrase" in names(tmp_path) and "pipeline" not in names(tmp_path)
