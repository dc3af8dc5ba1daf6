"""The driver's entry: it gives rows, and the library stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["region", "month", "lines", "revenue"] and got.count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_without_the_operators(tmp_path):
    for name in ("skein", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') for n in names) and 'pipeline' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_other_tests_stand_without_the_operators(tmp_path):
    """With both folders and the pipeline gone, every other test is still found, and one family of twins passes."""
    for name in ("skein", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, check=True, capture_output=True, text=True)
    assert "tests/test_twins.py" in run("tests", "--collect-only").stdout
    assert "passed" in run("tests/test_twins.py", "-k", "usage_by_nation or every_query").stdout


def test_a_missing_package_leaves_the_other_queries():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; names = e.queries(); assert names and 'pipeline' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "skein").rglob("*.py"):
        if "llm" not in path.parts:
            assert "skein.llm" not in path.read_text() and "import llm" not in path.read_text()
