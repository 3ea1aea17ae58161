import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__import__("tensorloom.plans.queries", fromlist=["x"]).queries()))
def test_core_queries_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    rows = df.collect()
    if sql is None:
        return
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)

    def text(v):
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    place = [want.columns.index(c) for c in columns]
    assert sorted([text(r[c]) for c in columns] for r in rows) == sorted([text(r[i]) for i in place] for r in want.fetchall())


def test_works_without_the_training_data_folder(tmp_path):
    root = Path(entry.__file__).parent
    for part in ("__spark_entry__.py", "tensorloom"):
        (tmp_path / part).symlink_to(root / part) if part.endswith(".py") else None
    copy = tmp_path / "tensorloom"
    copy.mkdir()
    for p in (root / "tensorloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'detection' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
