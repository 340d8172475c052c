"""The driver contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tidelog.plans.catalogue import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain([r[c] for c in columns] for r in got.collect()) == plain([r[i] for i in order] for r in found.fetchall())


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["user_id", "day", "value", "event_type", "props"]


@pytest.mark.parametrize("also", ["", "corpus_pipeline.py"])
def test_without_the_llm_folders(tmp_path, also):
    """Only the two folders are gone, and then the pipeline as well; what caches leave behind of a folder counts for nothing."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *[also] * bool(also)))
    (tmp_path / "r" / "tidelog" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lsm_full_scan' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=True)
    if not also:
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_parts.py", "tests/test_entry.py", "-k", "not without and not same_as_sql or lsm_full_scan"], cwd=tmp_path / "r", env=env, check=True)


def test_a_broken_import_is_no_missing_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    (tmp_path / "r" / "tidelog" / "llm").mkdir()
    (tmp_path / "r" / "tidelog" / "llm" / "__init__.py").write_text("")
    (tmp_path / "r" / "tidelog" / "llm" / "queries.py").write_text("import nowhere_to_be_found")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert done.returncode and "nowhere_to_be_found" in done.stderr


def test_nothing_else_imports_llm():
    for d, _, names in os.walk(os.path.join(ROOT, "tidelog")):
        if os.path.basename(d) != "llm":
            for x in names:
                if x.endswith(".py"):
                    with open(os.path.join(d, x)) as f:
                        assert "llm" not in f.read(), x
