"""The rest works without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_imports_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    assert (tmp_path / "repo/corpus_pipeline.py").exists() or not (ROOT / "corpus_pipeline.py").exists()
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr
