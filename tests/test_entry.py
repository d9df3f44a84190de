"""The driver's contract: registered queries against DuckDB on a small scale,
and the entry without the training-data subpackage."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from halyard import catalogue

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_without_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "halyard", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "halyard").mkdir()
    for p in (ROOT / "halyard").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "halyard" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "halyard").rglob("*.py"):
        if "llm" not in p.parts:
            assert "halyard.llm" not in p.read_text()
