"""The entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def environment(**more):
    """This process's environment without the repository's own folder on the import path; all else on it stays."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": os.pathsep.join(paths)} if paths else {}) | more


def said(folder, code=SAY):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=environment())
    assert done.returncode == 0, done.stderr
    return done


def names(folder, code=SAY):
    return set(said(folder, code).stdout.split())


def whole(tmp_path, *left_out):
    """A copy of the repository without the folders and files that are left out."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".tmp", *left_out))
    return tmp_path / "copy"


@pytest.mark.parametrize("left_out", [[], ["corpus_pipeline.py"]])
def test_entry_without_corpus_operators(tmp_path, left_out):
    found = names(whole(tmp_path, *left_out))
    assert "effective_diversity" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
    assert found <= names(ROOT)


def test_entry_without_what_the_corpus_operators_need():
    without = "import sys; sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None\n"
    done = said(ROOT, without + SAY)
    found = set(done.stdout.split())
    assert "effective_diversity" in found and "op3_exact_dedup" not in found
    if os.path.isdir(f"{ROOT}/tracewright/llm"):
        assert "tracewright.llm.queries are left out" in done.stderr


def test_other_tests_are_found_without_corpus_operators(tmp_path):
    """Collected, not run: that they import all they need from what is left."""
    copy = whole(tmp_path)
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=copy, capture_output=True, text=True, env=environment())
    assert done.returncode == 0, done.stdout


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
