"""Every query that has SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return repr(v.replace(tzinfo=None)) if getattr(v, "tzinfo", None) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    names = sorted(df.columns)
    assert sorted(duck.sql(f"SELECT * FROM ({sql})").columns) == names
    want = sorted(tuple(map(plain, x)) for x in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall())
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == want
