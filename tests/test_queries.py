"""Every query of the main library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestone.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return made


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the shared tables aren't here")
@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, con, name):
    own = QUERIES[name](spark, FOLDER)
    columns = sorted(own.columns)
    got = sorted([shown(r[c]) for c in columns] for r in own.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted([shown(v) for v in row] for row in con.execute(f"select {quoted} from ({SQL[name]})").fetchall())
