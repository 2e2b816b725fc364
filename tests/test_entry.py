import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_imports_without_the_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "ravelin", tmp_path / "ravelin", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "ravelin" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=60)
