"""Every query that SQL can express gives the SQL's rows on the small tables."""

import os

import duckdb
import pytest

from talentloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row)


def _same(a, b):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return a == b or (number(a) and number(b) and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    rel = sql.execute(catalog.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    plain = lambda x: float(x) if type(x).__name__ == "Decimal" else x
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want)
    assert all(_same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry_imports_without_the_pipeline(spark):
    import __spark_entry__ as entry

    assert "flagship_ranking" in entry.queries()
    assert entry.entry(spark).columns
