import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHOSEN = "q01 q02 q03 q04 q05 q07 q11 q14 q17 q18 q24 q25 q26 q27 q28 q29 q31 q33 q34 q35 f".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if any(n.startswith(c) for c in CHOSEN)])
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in found.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
