import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tapeline.plans import catalogue, streams  # noqa: F401

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in os.listdir(sf):
        path = f"{sf}/{file}"
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else list(value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_oracle(spark, sf, views, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*sorted(df.columns)).collect())
    assert got
    if name in catalogue.ORACLE:
        want = views.sql(catalogue.ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == sorted(repr([plain(v) for v in row]) for row in want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["file_index", "n_blocks", "timed"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_llm_folders(tmp_path):
    """The rest imports where the subpackage and the pipeline are absent."""
    for name in ("__spark_entry__.py", "tapeline"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    (tmp_path / "tapeline").mkdir()
    for item in (REPO / "tapeline").iterdir():
        if item.name != "llm":
            (tmp_path / "tapeline" / item.name).symlink_to(item)
    code = "import __spark_entry__ as e; print(len(e.queries()), e.llm_queries)"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), "None"], out.stderr
