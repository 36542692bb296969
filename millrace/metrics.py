"""Counters and histograms of the engine, labelled by catalog and table."""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from millrace.model import RewriteStats

LABELS = ("catalog_name", "table_ident")

Labels = tuple[str, str]


def exponential(start: float, factor: float, count: int) -> list[float]:
    return [start * factor**i for i in range(count)]


# Names and buckets that dashboards know.
_MIB = 1 << 20
COUNTERS = (
    "compaction_commit_counter",
    "compaction_commit_failed_counter",
    "compaction_executor_error_counter",
    "compaction_input_files_count",
    "compaction_output_files_count",
    "compaction_input_bytes_total",
    "compaction_output_bytes_total",
    "compaction_engine_records_processed_total",
    "compaction_engine_bytes_processed_total",
)
HISTOGRAMS = {
    "compaction_duration": exponential(1000, 4, 8),
    "compaction_commit_duration": exponential(10, 10, 5),
    "compaction_plan_execution_duration": exponential(1000, 4, 8),
    "compaction_plan_file_count": exponential(1, 2, 13),
    "compaction_plan_size_bytes": exponential(_MIB, 4, 12),
    "compaction_engine_batch_fetch_duration": exponential(1, 10, 6),
    "compaction_engine_batch_write_duration": exponential(1, 10, 6),
    "compaction_engine_batch_row_count_dist": exponential(100, 2, 10),
    "compaction_engine_batch_bytes_dist": exponential(64 * 1024, 2, 12),
}


class Registry(Protocol):
    """Where metrics go. Any object with these two methods will do."""

    def add(self, name: str, labels: Labels, value: float) -> None: ...

    def observe(self, name: str, labels: Labels, value: float, buckets: list[float]) -> None: ...


class NoopRegistry:
    def add(self, name: str, labels: Labels, value: float) -> None:
        pass

    def observe(self, name: str, labels: Labels, value: float, buckets: list[float]) -> None:
        pass


@dataclass
class MemoryRegistry:
    """Keeps everything; plans report from several threads."""

    counters: dict[tuple[str, Labels], float] = field(default_factory=dict)
    histograms: dict[tuple[str, Labels], list[int]] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, name: str, labels: Labels, value: float) -> None:
        with self.lock:
            self.counters[name, labels] = self.counters.get((name, labels), 0) + value

    def observe(self, name: str, labels: Labels, value: float, buckets: list[float]) -> None:
        with self.lock:
            self.histograms.setdefault((name, labels), [0] * (len(buckets) + 1))[bisect_left(buckets, value)] += 1


class Metrics:
    """Records for one table; values that are not positive are left out."""

    def __init__(self, registry: Registry | None = None, catalog_name: str = "default", table: str = "") -> None:
        self.registry, self.labels = registry or NoopRegistry(), (catalog_name, table)

    def add(self, name: str, value: float = 1) -> None:
        if value > 0:
            self.registry.add(name, self.labels, value)

    def observe(self, name: str, value: float) -> None:
        if value > 0:
            self.registry.observe(name, self.labels, value, HISTOGRAMS[name])

    def rewrite(self, stats: RewriteStats) -> None:
        self.add("compaction_input_files_count", stats.input_files_count)
        self.add("compaction_output_files_count", stats.output_files_count)
        self.add("compaction_input_bytes_total", stats.input_total_bytes)
        self.add("compaction_output_bytes_total", stats.output_total_bytes)

    def files(self, sizes: Sequence[tuple[int, int]], fetch_ms: float, write_ms: float) -> None:
        """Once for each plan: rows and bytes of each written file, which is what stands for a batch here; the time to get the
        plan's descriptors, and the time to write, for a file."""
        self.observe("compaction_engine_batch_fetch_duration", fetch_ms)
        for rows, size in sizes:
            self.observe("compaction_engine_batch_write_duration", write_ms / len(sizes))
            self.observe("compaction_engine_batch_row_count_dist", rows)
            self.observe("compaction_engine_batch_bytes_dist", size)

    def plan(self, stats: RewriteStats, milliseconds: float, rows: int = 0) -> None:
        """Once for each plan."""
        self.observe("compaction_plan_execution_duration", milliseconds)
        self.observe("compaction_plan_file_count", stats.input_files_count)
        self.observe("compaction_plan_size_bytes", stats.input_total_bytes)
        self.add("compaction_engine_records_processed_total", rows)
        self.add("compaction_engine_bytes_processed_total", stats.input_total_bytes)
