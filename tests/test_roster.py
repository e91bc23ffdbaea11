import os

import duckdb
import pytest

import __spark_entry__ as entry
from galeward.plans import stand_in

SF = "/root/testdata/sf0.001"
NAMES = ["gap_fill_whole", "rolling_modified_z", "window_features", "family_agreement", "window_effect", "case_studies", "taxonomy_verdicts", "stored_fit_health", "stored_percentile_sensitivity", "lstm_vs_gru", "recurrence_comparison", "displacement_hierarchy", "pair_columns_round_trip", "family_vote_jaccard", "decision_counts", "raw_stations", "raw_consolidated"]
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(str(round(x, 9) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)
    assert plain(got.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_shared_tables_are_stored_once_and_forgotten(spark):
    first = stand_in.wide(spark, SF)
    assert stand_in.wide(spark, SF) is first
    stand_in.forget()
    assert not os.path.exists(first._scratch) and stand_in.wide(spark, SF) is not first
