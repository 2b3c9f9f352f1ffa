"""Every registered query of the reference's operators against SQL on the same tables."""

import pytest

from tallyforge.plans import catalogue

from .conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols, want = duck_rows(catalogue.SQL[name], sf_dir)
    assert sorted(df.columns) == cols
    got = rows_of(df)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or (isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
