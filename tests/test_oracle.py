"""Every registered query of the library's own operators against its SQL on the small tables."""

import os

import duckdb
import pytest

from taxolark.plans import all_queries, all_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return c


def canonical(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])

    def text(x):
        if x is None or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(list(x) if isinstance(x, list | tuple) else x)

    return sorted("|".join(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, folder, con, name):
    df = all_queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in all_sql():
        assert df.columns
        return
    cur = con.execute(all_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(got, df.columns) == canonical(cur.fetchall(), names)
