"""Queries give the same rows when groups are cut into ranges as when they are not."""

import os

import pytest

from ballotlens.operators import prefix
from ballotlens.plans import audits, ballots, intake, rest

DATA = "/root/testdata/sf0.001"
NAMES = ("scan_sorted_manifest", "prn_sort_internal", "prn_sort_external", "pool_position", "v_prn_order", "v_index_sequential", "scan_county_pools", "alpha_mart", "betting_mart", "adaptive_betting", "adaptive_oneaudit", "clca_trial", "samplers", "tracker", "simulate_pool", "agrapa_bet")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, monkeypatch, name):
    query = next(m.QUERIES[name] for m in (audits, ballots, intake, rest) if name in m.QUERIES)
    rows = lambda: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in query(spark, DATA).fillna(-1).fillna("").collect())
    whole = rows()
    monkeypatch.setattr(prefix, "PER_BUCKET", 40)
    assert rows() == whole and whole
