import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tarnflow import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    one = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else int(x) if isinstance(x, (bool, int)) else str(x)
    return sorted(tuple(map(str, map(one, r))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if sql := queries.ORACLE_SQL.get(name):
        cells = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert plain(got) == plain(cells)


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_training_data_operators(tmp_path, pipeline):
    """The rest imports and lists its queries when the subpackage is gone, with or without the pipeline's file."""
    repo = Path(entry.__file__).parent
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    shutil.copytree(repo / "tarnflow", tmp_path / "tarnflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (repo / "corpus_pipeline.py").exists():
        shutil.copy(repo / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == sorted(queries.QUERIES), said.stderr
