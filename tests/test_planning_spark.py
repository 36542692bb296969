"""The planner on small manifests."""

import pytest
from pyspark.sql import functions as F

from millrace.model import CompactionPlan, FileGroup, file_tasks
from millrace.plans.auto import AutoPlanReason, AutoSelectedStrategy, auto_plan, capped, report_of
from millrace.plans.config import MIB, AutoCompactionConfig, AutoThresholds, BinPackConfig, FileGroupScope, FilesWithDeletesConfig, FullCompactionConfig, GroupFilters, SmallFilesConfig
from millrace.plans.strategy import strategy_of
from millrace.sources.files import balanced


def files(spark, rows):
    return file_tasks(spark, [{"file_path": f"f{i}", "length": size * MIB, "partition_key": key, "deletes": deletes} for i, (size, key, deletes) in enumerate(rows)])


def delete(path, content="pos", size=1024, ids=None):
    return {"file_path": path, "content": content, "length": size, "equality_ids": ids}


def totals(config, frame):
    return sorted(r["total_size"] // MIB for r in strategy_of(config).execute(frame)[1].collect())


P0, P1 = [10, 20, 5, 5, 15], [10, 20, 15, 5, 20, 5]


def test_bin_packing_by_partition(spark):
    frame = files(spark, [(s, "p0", []) for s in P0] + [(s, "p1", []) for s in P1])
    pack = BinPackConfig(50 * MIB)
    assert totals(FullCompactionConfig(grouping_strategy=pack), frame) == [5, 35, 40, 50]
    two = SmallFilesConfig(small_file_threshold_bytes=100 * MIB, grouping_strategy=pack, group_filters=GroupFilters(min_group_file_count=2))
    assert totals(two, frame) == [35, 40, 50]
    assert totals(SmallFilesConfig(small_file_threshold_bytes=100 * MIB, grouping_strategy=pack, group_filters=GroupFilters(36 * MIB)), frame) == [40, 50]


def test_null_and_empty_partition_are_one(spark):
    frame = files(spark, [(1, None, []), (1, None, []), (1, "", []), (1, "", []), (1, "a", []), (1, "b", [])])
    assert totals(FullCompactionConfig(), frame) == [1, 1, 4]
    assert totals(FullCompactionConfig(file_group_scope=FileGroupScope.TABLE), frame) == [6]


def test_scope_decides_what_a_gate_sees(spark):
    frame = files(spark, [(1, k, []) for k in "aabbc"])
    gate = {"small_file_threshold_bytes": 10 * MIB, "group_filters": GroupFilters(min_group_file_count=5)}
    assert totals(SmallFilesConfig(**gate), frame) == []
    assert totals(SmallFilesConfig(**gate, file_group_scope=FileGroupScope.TABLE), frame) == [5]


def test_size_bounds_are_min_inclusive_max_exclusive(spark):
    from millrace.plans.filters import SizeFilter

    frame = files(spark, [(s, "", []) for s in (2, 5, 10, 30, 50, 100)])
    kept = lambda low, high: sorted(r[0] // MIB for r in SizeFilter(low, high).filter(frame).select("length").collect())
    assert kept(5 * MIB, 50 * MIB) == [5, 10, 30]
    assert kept(None, None) == [2, 5, 10, 30, 50, 100] and kept(50 * MIB, 5 * MIB) == []


def test_deletes_count_once_a_group(spark):
    shared = [delete("e", "eq", 2048, [1]), delete("p")]
    frame = files(spark, [(10, "", shared), (10, "", shared), (10, "", [])])
    row = strategy_of(FilesWithDeletesConfig(min_delete_file_count_threshold=2)).execute(frame)[1].first()
    assert (row["data_file_count"], row["input_files_count"], row["input_total_bytes"]) == (2, 4, 20 * MIB + 1024 + 2048)
    assert strategy_of(FilesWithDeletesConfig(min_delete_file_count_threshold=0)).execute(frame)[1].first()["data_file_count"] == 3


def test_selected_files_are_those_of_kept_groups(spark):
    frame = files(spark, [(1, "a", []), (1, "a", []), (1, "b", [])])
    chosen, groups = strategy_of(SmallFilesConfig(group_filters=GroupFilters(min_group_file_count=2))).execute(frame)
    assert sorted(r[0] for r in chosen.select("file_path").collect()) == ["f0", "f1"] and groups.count() == 1
    assert strategy_of(SmallFilesConfig()).execute(frame.where("false"))[1].count() == 0


def test_auto(spark):
    small = files(spark, [(1, "", [])] * 6)
    assert auto_plan(None, AutoCompactionConfig()).reason is AutoPlanReason.NO_SNAPSHOT
    assert auto_plan(small.limit(2), AutoCompactionConfig()).reason is AutoPlanReason.NO_CANDIDATE
    r = auto_plan(small, AutoCompactionConfig())
    assert (r.reason, r.selected_strategy, len(r.plans), r.rewrite_ratio) == (AutoPlanReason.RECOMMENDED, AutoSelectedStrategy.SMALL_FILES, 1, 1.0)
    gated = AutoCompactionConfig(group_filters=GroupFilters(min_group_file_count=100))
    assert auto_plan(small, gated).reason is AutoPlanReason.NO_PLANS_PRODUCED
    heavy = files(spark, [(1, "", [delete("p")]), *[(1, "", [])] * 6])
    assert auto_plan(heavy, AutoCompactionConfig(min_delete_file_count_threshold=1)).selected_strategy is AutoSelectedStrategy.FILES_WITH_DELETES
    fallback = AutoCompactionConfig(min_delete_file_count_threshold=1, group_filters=GroupFilters(min_group_file_count=2))
    assert auto_plan(heavy, fallback).selected_strategy is AutoSelectedStrategy.SMALL_FILES
    parts = files(spark, [(n, k, []) for k, n in (("a", 1), ("b", 2), ("c", 3))])
    some = auto_plan(parts, AutoCompactionConfig(thresholds=AutoThresholds(1, 1), max_auto_plans_per_run=2))
    assert some.reason is AutoPlanReason.BUDGET_CAPPED and [p.group.partition_key for p in some.plans] == ["c", "b"] and some.rewrite_ratio == 5 / 6


def test_cap_recomputes():
    plans = [CompactionPlan(FileGroup(str(n), "", n, 1, data_bytes=n), "main", 1) for n in (10, 20, 30)]
    full = report_of(plans, 100, AutoPlanReason.RECOMMENDED, AutoSelectedStrategy.SMALL_FILES)
    cut = capped(full, 2, 100)
    assert (len(cut.plans), cut.planned_input_bytes, cut.planned_input_files, cut.rewrite_ratio, cut.reason) == (2, 30, 2, 0.3, AutoPlanReason.BUDGET_CAPPED)
    assert capped(full, 3, 100) is full and report_of([], 0, AutoPlanReason.RECOMMENDED, None).rewrite_ratio == 0


def test_columns_agree_with_functions(spark):
    from millrace.functions import sizing

    sizes = [0, 1, 999, 1000, 1001, 1750, 1751, 1999, 2000, 2100, 3300, 10_000, 123_456, 1 << 40]
    frame = spark.createDataFrame([(n,) for n in sizes], "n long")
    for target in (0, 1000, 7_000_000):
        got = frame.select("n", sizing.expected_output_files_col(F.col("n"), target).alias("e"), sizing.input_split_size_col(F.col("n"), target).alias("s")).collect()
        assert [(r["e"], r["s"]) for r in got] == [(sizing.expected_output_files(n, target), sizing.input_split_size(n, target)) for n in sizes]


def test_group_without_bytes_is_an_error(spark):
    with pytest.raises(Exception, match="No files to calculate task parallelism"):
        strategy_of(FullCompactionConfig()).execute(files(spark, [(0, "", [])]))[1].collect()


def test_balanced(spark):
    frame = files(spark, [(n, "", []) for n in (1000, 100, 100, 100, 100)])
    got = {r["split"]: r["n"] for r in balanced(frame, 2).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sorted(got.values()) == [1, 4]
