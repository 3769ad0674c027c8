"""Every query on the smallest tables, against its SQL where it has some."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.oracles import ORACLES
from ledgerloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*(f"`{c}`" for c in columns)).collect()
    if name in ORACLES:
        wanted = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLES[name]})").fetchall()
        assert canonical(rows) == canonical(wanted)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "amount", "count"]
    assert set(QUERIES) <= set(entry.queries())


def test_no_loop_joins(spark):
    for name in ("j1_accounts_with_counts", "j7_transfer_candidates", "c4_categorize", "c2_reconcile"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
