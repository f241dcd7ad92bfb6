"""The driver contract holds in a copy of the repository without the llm subpackage, its tests and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()), callable(e.entry))"


@pytest.mark.parametrize("gone", [["sedimenta/llm", "tests/llm"], ["sedimenta/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert run.returncode == 0, run.stderr
    n, llm, within, entry = run.stdout.split()
    assert int(n) > 100 and llm == "0" and within == entry == "True"
