"""Pairs with a response: their ends are looked up, the sites' other pairs are never formed."""

import pytest

from ohmgrid.operators import pairs as P
from ohmgrid.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pair_subset_mlpe", "pair_correlations", "pair_subset_leastsquares"])
def test_no_join_of_all_sites(spark, monkeypatch, name):
    formed = []

    def joined(sites, cols, pairs=None, f=P.site_pairs):
        formed.append(pairs)
        return f(sites, cols, pairs) if pairs is not None else f(sites, cols)

    monkeypatch.setattr(P, "site_pairs", joined)
    assert queries.QUERIES[name](spark, DATA).count() == 1
    assert formed and all(p is not None for p in formed)


def test_ends_of_given_pairs(spark):
    sites = spark.createDataFrame([(1, 5.0), (2, 7.0), (4, 1.0)], "site long, bal double")
    given = spark.createDataFrame([(2, 1, 0.5), (4, 2, 0.25), (4, 3, 1.0), (1, 4, 2.0)], "i long, j long, y double")
    got = {tuple(r) for r in P.endpoint_covariates(sites, ["bal"], pairs=given).collect()}
    assert got == {(2, 1, 0.5, 2.0), (4, 2, 0.25, 6.0)}  # 3 is no site, and i > j
