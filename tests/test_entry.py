import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["edges", "purity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def without_llm(tmp_path):
    """A copy of the repository as it is after both folders of the subpackage and the pipeline are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    return copy


def test_imports_without_a_session_and_without_the_subpackage(tmp_path):
    copy = without_llm(tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
    assert out.returncode == 0 and "cosine_knn_purity" in out.stdout and "op1_" not in out.stdout and "corpusloom.llm" in out.stderr, out.stderr


def test_a_missing_package_takes_only_the_subpackage_along(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and "cosine_knn_purity" in out.stdout and "op1_" not in out.stdout and "xxhash" in out.stderr, out.stderr


def test_the_pipeline_alone_is_left_out_too(tmp_path):
    """Only the two folders are deleted: what needs them is left out, the rest stays."""
    copy = without_llm(tmp_path)
    shutil.copy(ROOT / "corpus_pipeline.py", copy)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
    assert out.returncode == 0 and "knn_descent" in out.stdout and "pipeline" not in out.stdout and "op11_" not in out.stdout, out.stderr


def test_the_other_tests_run_without_the_subpackage(tmp_path):
    """Every other test file can be collected, and quick tests of several of them pass."""
    copy = without_llm(tmp_path)
    quick = "periods or titles or palette or weights or coded_links or centre_square or few_rows or settings"
    for options in (["--collect-only"], ["-x", "-k", quick]):
        out = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests", *options], cwd=copy, capture_output=True, text=True, timeout=900)
        assert out.returncode == 0, out.stdout[-3000:]
