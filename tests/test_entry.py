"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.schema == entry.entry(spark).schema


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(map(callable, entry.queries().values()))


def test_without_optional_parts(tmp_path):
    """A copy without the subpackage and the pipeline still imports and lists the other queries."""
    code = f"""
        import shutil, sys
        shutil.copytree({str(ROOT / 'weftgraph')!r}, {str(tmp_path / 'weftgraph')!r}, ignore=shutil.ignore_patterns('llm', '__pycache__'))
        shutil.copy({str(ROOT / '__spark_entry__.py')!r}, {str(tmp_path)!r})
        sys.path.insert(0, {str(tmp_path)!r})
        import __spark_entry__ as e
        assert e.__file__.startswith({str(tmp_path)!r})
        assert 'find_callers' in e.queries() and not any(k.startswith('op') for k in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})


def test_other_tests_without_optional_parts(tmp_path):
    """In a copy without the optional folders and the pipeline, other tests are found and pass."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stdout[-2000:]
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests/test_filters.py", "tests/test_entry.py", "-q", "-x", "-k", "not optional", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-2000:]
