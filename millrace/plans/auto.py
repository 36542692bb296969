"""The automatic planner: one look at a snapshot decides the strategy and explains it."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import CompactionPlan
from millrace.plans.config import AutoCompactionConfig, FilesWithDeletesConfig, SmallFilesConfig, SnapshotStats
from millrace.plans.strategy import group_of, strategy_of
from millrace.sources.shared import written


class AutoSelectedStrategy(Enum):
    FILES_WITH_DELETES = "FilesWithDeletes"
    SMALL_FILES = "SmallFiles"


class AutoPlanReason(Enum):
    RECOMMENDED = "Recommended"
    NO_SNAPSHOT = "NoSnapshot"
    NO_CANDIDATE = "NoCandidate"
    NO_PLANS_PRODUCED = "NoPlansProduced"
    BUDGET_CAPPED = "BudgetCapped"


@dataclass(frozen=True)
class AutoPlanReport:
    reason: AutoPlanReason
    selected_strategy: AutoSelectedStrategy | None = None
    plans: list[CompactionPlan] = field(default_factory=list)
    planned_input_bytes: int = 0
    planned_input_files: int = 0
    rewrite_ratio: float = 0.0


def stats_frame(files: DataFrame, small_threshold: int, min_deletes: int) -> DataFrame:
    """One row: total_data_files, small_files_count, delete_heavy_files_count, total_data_bytes; one pass."""
    heavy = F.count_if(F.size("deletes") >= min_deletes) if min_deletes > 0 else F.lit(0).cast("long")
    return files.agg(
        F.count(F.lit(1)).alias("total_data_files"),
        F.count_if(F.col("length") < small_threshold).alias("small_files_count"),
        heavy.alias("delete_heavy_files_count"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_data_bytes"),
    )


def plans_in_order(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups with files, the largest first (ties by id), so a budget always keeps the same ones."""
    groups = groups.where("data_file_count > 0").orderBy(F.col("total_size").desc(), "group_id")
    return groups if limit is None else groups.limit(limit)


def plans_of(assigned: DataFrame, groups: DataFrame, branch: str, snapshot_id: int, limit: int | None = None) -> list[CompactionPlan]:
    """A plan for each group, at most `limit`; plans are what the driver schedules, one row each.

    Files with their groups are written once, parted by group, so that a plan reads its own rows and plans nothing again.
    """
    file_columns = [c for c in assigned.columns if c not in ("scope", "bin", "group_id")]
    found = [group_of(row) for row in plans_in_order(groups, limit).collect()]
    if not found:
        return []
    if limit is not None:
        assigned = assigned.where(F.col("group_id").isin([g.group_id for g in found]))
    # a partition's name can't be empty, so it has a mark
    planned = written(assigned.select(*file_columns, F.concat(F.lit("g"), "group_id").alias("group_id")), "plans", "group_id")
    return [CompactionPlan(g, branch, snapshot_id, planned.where(F.col("group_id") == f"g{g.group_id}").select(*file_columns)) for g in found]


def report_of(plans: list[CompactionPlan], total_data_bytes: int, reason: AutoPlanReason, selected: AutoSelectedStrategy | None) -> AutoPlanReport:
    """The report's numbers, from the plans it holds."""
    data = sum(p.group.total_size for p in plans)
    return AutoPlanReport(reason, selected, plans, sum(p.total_bytes() for p in plans), sum(p.file_count() for p in plans), data / total_data_bytes if total_data_bytes else 0.0)


def capped(report: AutoPlanReport, budget: int | None, total_data_bytes: int) -> AutoPlanReport:
    """At most `budget` plans, and the numbers of these."""
    if budget is None or len(report.plans) <= budget:
        return report
    return report_of(report.plans[:budget], total_data_bytes, AutoPlanReason.BUDGET_CAPPED, report.selected_strategy)


def auto_plan(files: DataFrame | None, config: AutoCompactionConfig, branch: str = "main", snapshot_id: int = 0) -> AutoPlanReport:
    """Deletes first, then small files; never everything. files: the snapshot's data files, None if it has none."""
    if files is None:
        return AutoPlanReport(AutoPlanReason.NO_SNAPSHOT)
    row = stats_frame(files, config.small_file_threshold_bytes, config.min_delete_file_count_threshold).first()
    stats = SnapshotStats(row["total_data_files"], row["small_files_count"], row["delete_heavy_files_count"])
    candidates: list[tuple[AutoSelectedStrategy, FilesWithDeletesConfig | SmallFilesConfig]] = []
    if c := config.files_with_deletes_candidate(stats):
        candidates.append((AutoSelectedStrategy.FILES_WITH_DELETES, c))
    if c := config.small_files_candidate(stats):
        candidates.append((AutoSelectedStrategy.SMALL_FILES, c))
    if not candidates:
        return AutoPlanReport(AutoPlanReason.NO_CANDIDATE)
    for selected, planning in candidates:
        budget = config.max_auto_plans_per_run
        if plans := plans_of(*strategy_of(planning).execute(files), branch, snapshot_id, None if budget is None else budget + 1):
            report = report_of(plans, row["total_data_bytes"], AutoPlanReason.RECOMMENDED, selected)
            return capped(report, budget, row["total_data_bytes"])
    return AutoPlanReport(AutoPlanReason.NO_PLANS_PRODUCED)
