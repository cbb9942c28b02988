"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def listed(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_subpackage(tmp_path):
    for name in ("rasterloom", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "rasterloom" / "llm", ignore_errors=True)
    rest = listed(tmp_path)
    assert "min_slice_window_orientation" in rest and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in rest)
    assert rest <= listed(ROOT)


def test_entry_gives_rows(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
