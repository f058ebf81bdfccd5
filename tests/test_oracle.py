"""Every query with SQL against DuckDB on the small tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import catalogue as plans

SF = "/root/testdata/sf0.001"


def cell(x):
    return str(x.normalize()) if isinstance(x, Decimal) else str(x)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = plans.QUERIES[name](spark, SF)
    result = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r)) for r in result.fetchall()]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = sorted([cell(r[c]) for c in order] for r in got.collect())
    assert rows == sorted([cell(r[c]) for c in order] for r in want)
    assert rows or name == "contract_problems"


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
