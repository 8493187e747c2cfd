"""Every query against its SQL on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from logistra.catalog import QUERIES
from logistra.oracles import ORACLES as SQL

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


SPARK_TYPE = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def normal(rows, names):
    """Rows with columns in name order, sorted; -0.0 and 0.0 stay distinct."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(row[i] for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(value is None, str(value)) for value in row])


def signs(rows):
    return [math.copysign(1, v) for row in rows for v in row if isinstance(v, float) and v == 0]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_query(spark, duck, query):
    result = QUERIES[query](spark, FOLDER)
    expected = duck.execute(SQL[query])
    names = [column[0] for column in expected.description]
    types = {column[0]: SPARK_TYPE[str(column[1])] for column in expected.description}
    assert dict(result.dtypes) == types
    want = normal(expected.fetchall(), names)
    got = normal([tuple(row) for row in result.collect()], result.columns)
    assert len(got) == len(want) > 0
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, different[:5]
    assert -1.0 not in signs(got) and -1.0 not in signs(want)


def test_entry(spark):
    assert entry(spark).count() == 3
