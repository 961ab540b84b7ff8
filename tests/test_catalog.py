"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestrand.plans import catalog, flows  # noqa: F401  flows adds to the catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) if type(v).__name__ in ("datetime", "Timestamp") else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_as_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    want = db.execute(catalog.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_closure_query_reaches_the_root(spark):
    assert catalog.QUERIES["tier1_convergence"](spark, SMALL).columns == ["term_id", "n_species", "n_forms", "fan_in", "score"]
