"""Queries whose plans must not depend on what Spark guesses of a side's size."""

import contextlib

import pytest

import __spark_entry__ as entry


@contextlib.contextmanager
def written_plan(spark):
    """The number of broadcast joins in plans looked at, with a threshold that lets every side be broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        yield lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["manifest_diagnostics", "manifest_fixed_point", "manifest_reports", "manifest_summary", "manifest_applied", "manifest_requests", "manifest_replay_contexts"])
def test_manifests_are_dealt_by_key(spark, sf_dir, name):
    with written_plan(spark) as broadcasts:
        assert broadcasts(entry.queries()[name](spark, sf_dir)) == 0


@pytest.mark.parametrize("name, readings, shuffles", [("json_two_way", 1, 3), ("props_two_way", 1, 3), ("json_three_way", 1, 4)])
def test_json_is_read_once_for_all_revisions(spark, sf_dir, name, readings, shuffles):
    with written_plan(spark):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == readings
    assert plan.count("Exchange hashpartitioning") <= shuffles


def test_set_merge_has_more_parts_for_more_splits(spark, tmp_path):
    from confluo.operators import merge

    spark.range(1000).selectExpr("id % 10 AS k").repartition(20).write.parquet(str(tmp_path / "t"))
    with_splits = spark.read.option("mergeSchema", "false").parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        got = merge.set_merge(with_splits, with_splits.filter("k < 7"), with_splits.filter("k > 2"), ["k"])
        assert sorted(r.k for r in got.collect()) == [3, 4, 5, 6]
        # 3 sides of 20 splits, in four parts each
        assert got.rdd.getNumPartitions() == 240
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cases_are_dealt_by_parents_they_have(spark, sf_dir):
    with written_plan(spark) as broadcasts:
        found = entry.queries()["contract_cases"](spark, sf_dir)
        assert broadcasts(found) == 0
        plan = found._jdf.queryExecution().executedPlan().toString()
    # nothing is joined to the parents from outside, where nulls would stay
    assert "LeftOuter" not in plan and "LeftAnti" in plan


def test_contract_documents_are_made_once(spark, sf_dir):
    """Rules read the stored documents; none makes them anew from lines and orders."""
    from confluo.plans import contract_docs

    for query in (contract_docs.contract_records, contract_docs.contract_summaries):
        assert not [f for f in query(spark, sf_dir).inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_freeze_blocks_read_lines_once(spark, sf_dir):
    with written_plan(spark):
        plan = entry.queries()["freeze_directive_blocks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
