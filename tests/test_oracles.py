"""A selection of registered queries next to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave.catalog.registry import TABLES
from tools.check import canon

SF = "/root/testdata/sf0.001"
NAMES = ("j3_bin_metadata", "a4_nuclei", "j5_candidate_radius_join", "j6_nearest_other_nucleus", "a8_bin_log_likelihood", "g9_add_score",
         "g19_objective_deltas", "a22_overlap_metrics", "a16_hull_and_solidity", "j16_tile_membership", "w7_discounted_return", "w8_advantages", "w13_owner_at_step", "s11_trajectory_at_step", "a36_silhouette_of_types",
         "j20_patch_bins", "g20_fill_target")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
