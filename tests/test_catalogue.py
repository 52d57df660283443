"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from folio import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name, table", [("sort_asc_all", "orders"), ("sort_desc_ties_all", "orders"), ("sort_nulls_last_all", "documents"), ("sort_desc_nulls_last_all", "documents"), ("sort_only_all", "labels")])
def test_whole_sorts_return_every_row(spark, duck, name, table):
    ranks = [r["rank"] for r in catalogue.queries()[name](spark, SF).collect()]
    n = duck.execute(f"SELECT count(*) FROM {table}" + " WHERE quality IS NOT NULL" * (table == "labels")).fetchone()[0]
    assert sorted(ranks) == list(range(1, n + 1))


def test_entry(spark):
    assert entry_point.entry(spark).columns
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("gone", ["('folio.llm', 'corpus_pipeline')", "('corpus_pipeline',)", "('tiktoken',)", "('xxhash', 'zstandard')"])
def test_stands_without_the_optional_part(gone):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_point.__file__).parent
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        f"        if name.startswith({gone}): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'topk' in names and 'pipeline' not in names and set(e.oracle_sql()) <= names\n"
        f"assert any(k.startswith('op1_') for k in names) == ({gone} == ('corpus_pipeline',) and {(root / 'folio' / 'llm').exists()})\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
