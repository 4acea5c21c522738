import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphfold import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in found), key=str)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([tuple(r[i] for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("missing", ["graphfold.llm", "regex", "zstandard", "public_tokenizers"])
def test_own_queries_need_no_training_data_modules(missing):
    """Without the subpackage, or a module that only it uses, the engine's own queries are still there."""
    code = f"""
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + "."!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
import __spark_entry__ as entry
from graphfold import queries as own
assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
assert len(own.QUERIES) == len(own.ORACLE_SQL)
"""
    got = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
