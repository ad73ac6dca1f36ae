"""Each registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(found, names):
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cur = duck.execute(registry.oracle_sql()[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), [x[0] for x in cur.description])
