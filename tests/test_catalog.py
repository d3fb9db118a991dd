"""Every registered query against its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablework.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [columns[i] for i in order], sorted([tuple(norm(row[i]) for i in order) for row in data], key=repr)


def difference(spark, name, d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(catalog.ORACLE[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0] or len(got[1]) != len(want[1]):
        return f"{got[0]} {want[0]} {len(got[1])} {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, name):
    assert difference(spark, name, DIR) is None


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_entry_and_rows_only(spark):
    assert entry.entry(spark).count() > 0
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE)):
        assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_unknown_condition(spark):
    from tablework.functions import conditions

    with pytest.raises(ValueError):
        conditions.condition(spark.range(1), {"column": "id", "op": "no"})
