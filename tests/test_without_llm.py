"""The rest of the library stands without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_and_registers(tmp_path):
    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert not [n for n in q if n[0] == 'p' and n[1:2].isdigit()]; assert set(s) <= set(q); print(len(q), len(s))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    queries, sql = map(int, run.stdout.split()[-2:])
    assert queries > 60 and sql > 50


def test_nothing_outside_imports_it():
    for p in [*(ROOT / "folioscope").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in p.relative_to(ROOT).parts and p.name != "test_without_llm.py":
            assert "folioscope.llm" not in p.read_text(), p
