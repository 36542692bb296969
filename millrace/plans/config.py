"""Every knob, with its default and its check."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import Enum

from millrace.errors import ConfigError

MIB, GIB = 1 << 20, 1 << 30

# The defaults that a switch of engines must not change.
TARGET_FILE_SIZE = GIB
VALIDATE = False
BATCH_ROWS = 1024
CONCURRENT_CLOSES = 4
ROW_GROUP_BYTES = 128 * MIB
NORMALIZED_IDENTIFIERS = True
SMALL_FILE_THRESHOLD = 32 * MIB
MIN_SIZE_PER_PARTITION = 512 * MIB
MAX_FILES_PER_PARTITION = 32
CONCURRENT_PLANS = 4
MIN_DELETE_FILES = 128
PREFETCH = False
AUTO_MIN_SMALL_FILES = 5
AUTO_MIN_DELETE_HEAVY_FILES = 1
BIN_PACK_TARGET = 100 * GIB
SPLIT_OVERHEAD = 5 * MIB

FILE_PREFIX = "millrace"


def available_parallelism() -> int:
    return os.cpu_count() or 1


class FileGroupScope(Enum):
    PARTITION = "Partition"
    TABLE = "Table"


@dataclass(frozen=True)
class BinPackConfig:
    target_group_size_bytes: int = BIN_PACK_TARGET


@dataclass(frozen=True)
class Single:
    """All files of a scope are one group."""


Grouping = Single | BinPackConfig


@dataclass(frozen=True)
class GroupFilters:
    """Groups below either bound are not rewritten; None or 0 is no bound."""

    min_group_size_bytes: int | None = None
    min_group_file_count: int | None = None


@dataclass(frozen=True)
class FullCompactionConfig:
    """Every data file is rewritten; group filters don't apply."""

    target_file_size_bytes: int = TARGET_FILE_SIZE
    min_size_per_partition: int = MIN_SIZE_PER_PARTITION  # accepted, without effect
    max_file_count_per_partition: int = MAX_FILES_PER_PARTITION
    max_input_parallelism: int = field(default_factory=lambda: 4 * available_parallelism())
    max_output_parallelism: int = field(default_factory=available_parallelism)
    enable_heuristic_output_parallelism: bool = True
    grouping_strategy: Grouping = Single()
    file_group_scope: FileGroupScope = FileGroupScope.PARTITION

    def __post_init__(self) -> None:
        if self.max_input_parallelism < 1 or self.max_output_parallelism < 1:
            raise ConfigError("parallelism must be at least 1")
        if self.max_file_count_per_partition < 1:
            raise ConfigError("max_file_count_per_partition must be at least 1")
        if self.target_file_size_bytes < 0:
            raise ConfigError("target_file_size_bytes must not be negative")


@dataclass(frozen=True)
class SmallFilesConfig(FullCompactionConfig):
    """Data files below a size are rewritten."""

    small_file_threshold_bytes: int = SMALL_FILE_THRESHOLD
    group_filters: GroupFilters = GroupFilters()


@dataclass(frozen=True)
class FilesWithDeletesConfig(FullCompactionConfig):
    """Data files with enough delete files are rewritten; 0 selects all."""

    min_delete_file_count_threshold: int = MIN_DELETE_FILES
    group_filters: GroupFilters = GroupFilters()


PlanningConfig = FullCompactionConfig | SmallFilesConfig | FilesWithDeletesConfig


@dataclass(frozen=True)
class ExecutionConfig:
    target_file_size_bytes: int = TARGET_FILE_SIZE
    data_file_prefix: str = FILE_PREFIX
    enable_validate_compaction: bool = VALIDATE
    max_record_batch_rows: int = BATCH_ROWS
    max_concurrent_closes: int = CONCURRENT_CLOSES  # Spark closes one file a task: without effect
    compression: str = "zstd"
    row_group_bytes: int = ROW_GROUP_BYTES
    enable_normalized_column_identifiers: bool = NORMALIZED_IDENTIFIERS
    max_concurrent_compaction_plans: int = CONCURRENT_PLANS
    enable_prefetch: bool = PREFETCH  # a hint that Spark's readers don't need: without effect
    max_memory_bytes: int | None = None  # Spark's own memory manager bounds and spills: without effect
    spill_dir: str | None = None  # spark.local.dir: without effect
    null_safe_equality_deletes: bool = False  # whether a null in an equality delete matches nulls
    broadcast_deletes_bytes: int = 64 * MIB  # delete files up to this many bytes are broadcast

    def __post_init__(self) -> None:
        if self.max_concurrent_compaction_plans < 1 or self.target_file_size_bytes < 1:
            raise ConfigError("max_concurrent_compaction_plans and target_file_size_bytes must be at least 1")


@dataclass(frozen=True)
class CompactionConfig:
    planning: PlanningConfig = field(default_factory=FullCompactionConfig)
    execution: ExecutionConfig = ExecutionConfig()


@dataclass(frozen=True)
class AutoThresholds:
    """How many candidate files make a strategy worthwhile; 0 turns it off."""

    min_small_files_count: int = AUTO_MIN_SMALL_FILES
    min_delete_heavy_files_count: int = AUTO_MIN_DELETE_HEAVY_FILES


@dataclass(frozen=True)
class SnapshotStats:
    total_data_files: int
    small_files_count: int
    delete_heavy_files_count: int


@dataclass(frozen=True)
class AutoCompactionConfig:
    thresholds: AutoThresholds = AutoThresholds()
    target_file_size_bytes: int = TARGET_FILE_SIZE
    min_size_per_partition: int = MIN_SIZE_PER_PARTITION
    max_file_count_per_partition: int = MAX_FILES_PER_PARTITION
    max_input_parallelism: int = field(default_factory=lambda: 4 * available_parallelism())
    max_output_parallelism: int = field(default_factory=available_parallelism)
    enable_heuristic_output_parallelism: bool = True
    small_file_threshold_bytes: int = SMALL_FILE_THRESHOLD
    min_delete_file_count_threshold: int = MIN_DELETE_FILES
    grouping_strategy: Grouping = Single()
    group_filters: GroupFilters = GroupFilters()
    max_auto_plans_per_run: int | None = None  # None: no limit
    execution: ExecutionConfig = ExecutionConfig()

    def _common(self) -> dict:
        names = ("target_file_size_bytes", "min_size_per_partition", "max_file_count_per_partition", "max_input_parallelism", "max_output_parallelism", "enable_heuristic_output_parallelism", "grouping_strategy", "group_filters")
        return {n: getattr(self, n) for n in names} | {"file_group_scope": FileGroupScope.PARTITION}

    def files_with_deletes_candidate(self, stats: SnapshotStats) -> FilesWithDeletesConfig | None:
        """The delete strategy's config if enough files are delete-heavy; the share of files doesn't matter."""
        least = self.thresholds.min_delete_heavy_files_count
        if stats.total_data_files <= 1 or self.min_delete_file_count_threshold == 0 or least == 0 or stats.delete_heavy_files_count < least:
            return None
        return FilesWithDeletesConfig(**self._common(), min_delete_file_count_threshold=self.min_delete_file_count_threshold)

    def small_files_candidate(self, stats: SnapshotStats) -> SmallFilesConfig | None:
        """The small-file strategy's config if enough files are small."""
        least = self.thresholds.min_small_files_count
        if stats.total_data_files <= 1 or least == 0 or stats.small_files_count < least:
            return None
        return SmallFilesConfig(**self._common(), small_file_threshold_bytes=self.small_file_threshold_bytes)


@dataclass(frozen=True)
class RetryConfig:
    max_retries: int = 3
    initial_delay_s: float = 1.0
    max_delay_s: float = 10.0

    def delay(self, attempt: int) -> float:
        return min(self.max_delay_s, self.initial_delay_s * 2**attempt)


