"""Every registered query of the reference operators against its SQL, as the driver compares them."""

import duckdb
import pytest

from logweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    return float(x) if hasattr(x, "quantize") or isinstance(x, (int, float)) and not isinstance(x, bool) else x


def normal(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*[table[c].to_pylist() for c in names])), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    assert normal(got.toArrow()) == normal(duck.execute(registry.ORACLE_SQL[name]).to_arrow_table())
