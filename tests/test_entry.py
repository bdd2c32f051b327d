import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f'CREATE VIEW "{path.stem}" AS SELECT * FROM \'{path}\'')
    return connection


def one(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([one(r[i]) for i in order] for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert table(df.columns, df.collect()) == table(names, found.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "person_id"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_packed_fields_of_the_data(spark):
    rows = entry.queries()["p4_found"](spark, DATA).collect()
    assert rows and all(r.item and r.pos >= 1 for r in rows)
    assert len({(r.person_id, r.field_name, r.pos) for r in rows}) == len(rows)
