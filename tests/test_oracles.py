"""Every query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from plinth.plans import registry

SF = os.environ.get("PLINTH_SF", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = db.execute(registry.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in rel.description}
    assert sorted(kinds) == columns
    assert [(c, kinds[c]) for c, k in df.dtypes if k in KINDS and KINDS[k] != kinds[c]] == []
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=order)
    assert got == want
    assert got or name == "scan_filter"
