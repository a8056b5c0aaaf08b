"""Every registered query against its SQL twin, and a look at its plan."""

import pytest
from compare import SF, compare, oracle

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], ORACLES[name])
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(
    "name",
    ["d1_frames_to_sections", "d3_assign_sections", "d4_assign_parts", "d5_flag_silence",
     "f1_boundary_windows", "m6_collection_requests", "s3_stuck_jobs", "e7_merge_glossary"],
)
def test_plan_has_no_nested_loop(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flagship_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["source_id", "title", "ts", "words_in", "words_out", "ratio", "tier"]
    assert rows.count() > 0
