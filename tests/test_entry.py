import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def value(x):
    return repr(round(x, 7)) if isinstance(x, float) else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str | bytes) else str(x)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = __spark_entry__.queries()[name](spark, SF)
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(value(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = sorted(tuple(value(r[k]) for k in at) for r in theirs.fetchall())
    assert a == b
