"""Every query of the catalogue against its SQL on the smallest tables."""

import decimal
import math

import pytest

from tessera import catalogue

NAMES = sorted(catalogue.queries())


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = sorted(repr(tuple(cell(r[c]) for c in sorted(df.columns))) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in sorted(names)]
    want = sorted(repr(tuple(cell(row[i]) for i in place)) for row in found.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(NAMES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(NAMES) <= set(__spark_entry__.queries())
