import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"]
    assert df.count() > 0


def test_works_without_the_llm_subpackage(tmp_path):
    for name in ("sievework", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "sievework/llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 40


def test_works_without_a_library_of_the_llm_subpackage(tmp_path):
    for name in ("sievework", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    (tmp_path / "zstandard.py").write_text("raise ImportError('no such wheel')")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 40
    assert out.stdout.split()[1] == "False"
