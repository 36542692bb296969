"""Packing, sizing, config and metrics as plain functions."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.errors import ConfigError, ExecutionError, ValidationError
from millrace.functions import sizing
from millrace.functions.transforms import murmur3_32, zero_seed
from millrace.metrics import HISTOGRAMS, MemoryRegistry, Metrics
from millrace.plans.config import GIB, MIB, AutoCompactionConfig, AutoThresholds, BinPackConfig, FileGroupScope, FilesWithDeletesConfig, FullCompactionConfig, GroupFilters, RetryConfig, SmallFilesConfig, SnapshotStats
from millrace.plans.filters import DeleteFileCountFilter, MinGroupFileCount, MinGroupSize, SizeFilter
from millrace.plans.packer import ListPacker, split_balanced
from millrace.plans.strategy import strategy_of


def packed(target, weights, lookback=1):
    return ListPacker(target, lookback).pack(weights, lambda w: w)


@pytest.mark.parametrize(
    ("target", "weights", "bins"),
    [
        (100, [10, 90, 5, 50, 40], [[90], [50, 40, 10], [5]]),
        (100, [60, 30, 30, 30], [[60, 30], [30, 30]]),
        (0, [100, 200, 300], [[300, 200, 100]]),
        (100, [60, 50, 30, 20], [[60], [50, 30, 20]]),
        (100, [], []),
        (10, [50, 5], [[50], [5]]),
    ],
)
def test_packer(target, weights, bins):
    assert packed(target, weights) == bins


def test_packer_bin_counts():
    assert len(packed(50 * MIB, [30 * MIB] * 3 + [10 * MIB])) == 3
    assert len(packed(25 * MIB, [10 * MIB, 10 * MIB, 5 * MIB, 10 * MIB, 5 * MIB])) == 2
    assert len(packed(64 * MIB, [4 * MIB] * 50)) == 4
    big = (1 << 63) - 1
    assert packed(big * 2, [big, big]) == [[big, big]]


def test_packer_is_stable_and_looks_back():
    items = [("a", 5), ("b", 5), ("c", 5)]
    assert ListPacker(10).pack(items, lambda x: x[1]) == [[("a", 5), ("b", 5)], [("c", 5)]]
    assert packed(100, [80, 70, 20], lookback=2) == [[80], [70, 20]]
    with pytest.raises(ConfigError):
        ListPacker(10, 0)


@given(st.integers(1, 1000), st.lists(st.integers(0, 1500), max_size=60), st.integers(1, 5))
def test_packer_keeps_items_and_bounds(target, weights, lookback):
    bins = packed(target, weights, lookback)
    assert sorted(w for b in bins for w in b) == sorted(weights)
    assert all(sum(b) <= target or len([w for w in b if w]) == 1 for b in bins)


def test_balanced_splits():
    spread = [sum(range(101, 113)[i] for i in s) for s in split_balanced(list(range(101, 113)), 3)]
    assert max(spread) - min(spread) <= 10
    assert split_balanced([1000, 100, 100, 100, 100], 2) == [[0], [1, 2, 3, 4]]
    assert split_balanced([], 2) == [[], []]


@pytest.mark.parametrize(
    ("input_bytes", "files", "split"),
    [
        (500 * MIB, 1, 1073741824),
        (GIB, 1, 1078984704),
        (GIB * 3 // 2, 2, 1073741824),
        (GIB * 7 // 4, 2, 1073741824),
        (2 * GIB + 200 * MIB, 2, 1183842304),
        (3 * GIB + 100 * MIB, 3, 1113937237),
        (4 * GIB, 4, 1078984704),
        (10000 * MIB, 10, 1073741824),
        (25000 * MIB, 24, 1097509546),
    ],
)
def test_sizing_goldens(input_bytes, files, split):
    assert sizing.expected_output_files(input_bytes, GIB) == files
    assert sizing.input_split_size(input_bytes, GIB) == split
    assert sizing.write_max_file_size(GIB) == 1503238553


def test_parallelism():
    config = FullCompactionConfig(target_file_size_bytes=GIB, max_input_parallelism=8, max_output_parallelism=4, max_file_count_per_partition=10)
    of = lambda n, each: sizing.parallelism(n * each, n, n * each, config)
    assert of(100, 10 * MIB)[0] == 8 and of(50, 500 * MIB)[0] == 8
    assert [of(n, b * MIB)[1] for n, b in ((1000, 1), (100, 100), (1, 100), (4, 1024))] == [1, 4, 1, 4]
    assert sizing.output_parallelism_heuristic(4, 0, 100) == 4 and sizing.output_parallelism_heuristic(4, 99, 100) == 1
    with pytest.raises(ExecutionError, match="No files to calculate task parallelism"):
        sizing.parallelism(0, 0, 0, config)


def test_config_checks_and_defaults():
    assert FullCompactionConfig().target_file_size_bytes == GIB and SmallFilesConfig().small_file_threshold_bytes == 32 * MIB
    assert FilesWithDeletesConfig().min_delete_file_count_threshold == 128 and BinPackConfig().target_group_size_bytes == 100 * GIB
    for bad in ({"max_input_parallelism": 0}, {"max_output_parallelism": 0}, {"max_file_count_per_partition": 0}):
        with pytest.raises(ConfigError, match="Invalid configuration"):
            FullCompactionConfig(**bad)
    assert [RetryConfig().delay(i) for i in range(5)] == [1, 2, 4, 8, 10]


@pytest.mark.parametrize(("total", "small", "heavy", "want"), [(10, 5, 1, (True, True)), (10, 4, 0, (False, False)), (1, 1, 1, (False, False)), (1000, 5, 1, (True, True)), (10, 6, 0, (False, True))])
def test_auto_candidates(total, small, heavy, want):
    config, stats = AutoCompactionConfig(), SnapshotStats(total, small, heavy)
    got = config.files_with_deletes_candidate(stats), config.small_files_candidate(stats)
    assert tuple(c is not None for c in got) == want
    assert all(c.file_group_scope is FileGroupScope.PARTITION for c in got if c)


def test_auto_zero_turns_off():
    stats = SnapshotStats(10, 10, 10)
    assert AutoCompactionConfig(thresholds=AutoThresholds(0, 0)).small_files_candidate(stats) is None
    assert AutoCompactionConfig(thresholds=AutoThresholds(0, 0)).files_with_deletes_candidate(stats) is None
    assert AutoCompactionConfig(min_delete_file_count_threshold=0).files_with_deletes_candidate(stats) is None


def test_descriptions():
    assert str(SizeFilter(5 * MIB, 50 * MIB)) == "SizeFilter[5-50MB]" and str(SizeFilter(5 * MIB)) == "SizeFilter[>5MB]"
    assert str(SizeFilter(None, MIB)) == "SizeFilter[<1MB]" and str(SizeFilter()) == "SizeFilter[Any]"
    assert str(DeleteFileCountFilter(3)) == "DeleteFileCountFilter[>=3 deletes]"
    assert str(MinGroupSize(5 * MIB)) == "MinGroupSize[5MB]" and str(MinGroupFileCount(2)) == "MinGroupFileCount[2]"
    full = FullCompactionConfig(grouping_strategy=BinPackConfig(20 * MIB), file_group_scope=FileGroupScope.TABLE)
    assert str(strategy_of(full)) == "NoFileFilters -> Table -> BinPackGrouping[target=20MB] -> NoGroupFilters"
    small = SmallFilesConfig(small_file_threshold_bytes=MIB, group_filters=GroupFilters(5 * MIB, 2))
    assert str(strategy_of(small)) == "SizeFilter[<1MB] -> SingleGrouping -> MinGroupSize[5MB] -> MinGroupFileCount[2]"
    assert not strategy_of(SmallFilesConfig(group_filters=GroupFilters(0, 0))).group_filters
    assert not strategy_of(FilesWithDeletesConfig(min_delete_file_count_threshold=0)).file_filters


def test_murmur_published_values():
    assert murmur3_32((34).to_bytes(8, "little")) == 2017239379
    assert murmur3_32(b"hello") == 0x248BFA47 and murmur3_32(b"hello, world") == 0x149BBB7F
    assert murmur3_32((34).to_bytes(8, "little")) == 2017239379
    assert murmur3_32(zero_seed().to_bytes(4, "little", signed=True), 42) == 0


def test_metrics():
    registry = MemoryRegistry()
    m = Metrics(registry, "c", "t")
    m.add("compaction_commit_counter")
    m.add("compaction_commit_counter", 0)
    m.observe("compaction_commit_duration", 11)
    m.observe("compaction_commit_duration", -1)
    assert registry.counters == {("compaction_commit_counter", ("c", "t")): 1}
    assert registry.histograms["compaction_commit_duration", ("c", "t")] == [0, 1, 0, 0, 0, 0]
    assert HISTOGRAMS["compaction_plan_file_count"][-1] == 4096 and HISTOGRAMS["compaction_duration"][-1] == 16384000


def test_error_prefixes():
    assert str(ConfigError("x")) == "Invalid configuration: x" and str(ExecutionError("x")) == "Execution failed: x" and str(ValidationError("x")) == "Compaction validator failed: x"
