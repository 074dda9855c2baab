"""The driver contract, and a few queries against their SQL twins."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_contract():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 110


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["h5_poincare_dist", "e1_edges_from_events", "p4_node_phases", "s4_graph_invariants", "o2_future_links", "v1_recovery_rate"])
def test_twins(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(rs, names):
        return sorted(tuple(None if r[i] is None or (isinstance(r[i], float) and math.isnan(r[i])) else r[i] for i in (names.index(c) for c in cols)) for r in rs)

    assert str(rows(got.collect(), got.columns)) == str(rows(want.fetchall(), want.columns))
