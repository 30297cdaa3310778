"""The core works where the operators for training data are absent."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
LIST = "import re, __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(bool(re.match(r'op[0-9]+_|pipeline$', k)) for k in q))"


def listed(root):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(root)})
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()))


def test_queries_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "heronlake", tmp_path / "heronlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    alone = listed(tmp_path)
    assert alone[0] > 40 and alone[1] == 0
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert listed(tmp_path) == alone


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "heronlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "heronlake.llm" not in path.read_text(), path
