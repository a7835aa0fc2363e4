"""The driver contract, with and without the optional sub-package."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def registered(root):
    return subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, capture_output=True, text=True, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)}).stdout.split()


def test_queries_without_the_sub_package(tmp_path):
    copytree(ROOT / "tendril", tmp_path / "tendril", ignore=ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (tmp_path / name).write_text((ROOT / name).read_text())
    n, pipeline, llm = registered(tmp_path)
    assert int(n) > 40 and pipeline == llm == "False"
    if (tmp_path / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").unlink()
        assert registered(tmp_path) == [n, "False", "False"]
