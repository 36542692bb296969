"""Compaction from plan to commit: managed, in separate steps, or with the automatic planner."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import CommitConflict, CompactionError, ExecutionError, TableError
from millrace.metrics import Metrics, Registry
from millrace.model import DATA, POSITION_DELETES, CompactionPlan, CompactionResult, RewriteResult, RewriteStats
from millrace.operators.rewrite import Executor, RewriteRequest, SparkExecutor
from millrace.operators.validate import CompactionValidator
from millrace.plans.auto import AutoPlanReason, AutoPlanReport, auto_plan, plans_of
from millrace.plans.config import AutoCompactionConfig, CompactionConfig, ExecutionConfig, PlanningConfig, RetryConfig
from millrace.plans.strategy import strategy_of
from millrace.sources.table import MAIN, Catalog, Table, custom_properties


def check_consistent(results: Sequence[RewriteResult], snapshot_id: int, branch: str) -> None:
    """All results are of one snapshot and one branch."""
    for r in results:
        if r.plan.to_branch != branch:
            raise ExecutionError(f"Compaction plan branch '{r.plan.to_branch}' does not match configured branch '{branch}'")
        if r.plan.snapshot_id != snapshot_id:
            raise ExecutionError(f"Compaction plan snapshot '{r.plan.snapshot_id}' does not match other plans snapshot '{snapshot_id}'")


def merge_stats(stats: Sequence[RewriteStats]) -> RewriteStats:
    return reduce(add, stats, RewriteStats())


class CompactionPlanner:
    """Plans for a fixed strategy."""

    def __init__(self, config: PlanningConfig) -> None:
        self.config = config

    def plan_compaction(self, table: Table) -> list[CompactionPlan]:
        return self.plan_compaction_with_branch(table, MAIN)

    def plan_compaction_with_branch(self, table: Table, branch: str) -> list[CompactionPlan]:
        """A plan for each group; none if the branch is unknown or empty."""
        snapshot = table.metadata.snapshot_for(branch)
        if snapshot is None:
            return []
        return plans_of(*strategy_of(self.config).execute(table.file_tasks(snapshot.snapshot_id)), branch, snapshot.snapshot_id)


class AutoCompactionPlanner:
    def __init__(self, config: AutoCompactionConfig = AutoCompactionConfig()) -> None:
        self.config = config

    def plan_compaction_report_with_branch(self, table: Table, branch: str = MAIN) -> AutoPlanReport:
        snapshot = table.metadata.snapshot_for(branch)
        if snapshot is None:
            return AutoPlanReport(AutoPlanReason.NO_SNAPSHOT)
        return auto_plan(table.file_tasks(snapshot.snapshot_id), self.config, branch, snapshot.snapshot_id)

    def plan_compaction_with_branch(self, table: Table, branch: str = MAIN) -> list[CompactionPlan]:
        return self.plan_compaction_report_with_branch(table, branch).plans


@dataclass(frozen=True)
class CommitParams:
    """What a commit was planned with."""

    starting_snapshot_id: int
    schema_id: int
    use_starting_sequence_number: bool = True


class CommitManager:
    """Swaps files in one snapshot, and tries again if another commit came first.

    New files keep the starting snapshot's sequence number, so an equality delete that came meanwhile still applies to
    them. Position deletes that came meanwhile name files that go, so the commit is refused.
    """

    def __init__(self, load: Callable[[], Table], params: CommitParams, retry: RetryConfig = RetryConfig(), metrics: Metrics | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.load, self.params, self.retry, self.metrics, self.sleep = load, params, retry, metrics or Metrics(), sleep

    def rewrite_files_from_results(self, results: Sequence[RewriteResult], branch: str) -> Table:
        return self._from_results(results, branch, "replace")

    def overwrite_files_from_results(self, results: Sequence[RewriteResult], branch: str) -> Table:
        return self._from_results(results, branch, "overwrite")

    def _from_results(self, results: Sequence[RewriteResult], branch: str, operation: str) -> Table:
        if not results:
            raise ExecutionError("No rewrite results to commit")
        paths = reduce(DataFrame.union, [r.plan.files.select("file_path") for r in results])
        return self.commit([f for r in results for f in r.output_files], paths, branch, operation)

    def rewrite_files(self, added: list, removed_paths: DataFrame, branch: str) -> Table:
        return self.commit(added, removed_paths, branch, "replace")

    def overwrite_files(self, added: list, removed_paths: DataFrame, branch: str) -> Table:
        return self.commit(added, removed_paths, branch, "overwrite")

    def commit(self, added: list, removed_paths: DataFrame, branch: str, operation: str) -> Table:
        began = time.monotonic()
        for attempt in range(self.retry.max_retries + 1):
            try:
                table = self._once(added, removed_paths, branch, operation)
                self.metrics.add("compaction_commit_counter")
                self.metrics.observe("compaction_commit_duration", (time.monotonic() - began) * 1000)
                return table
            except CommitConflict:
                self.metrics.add("compaction_commit_failed_counter")
                if attempt == self.retry.max_retries:
                    raise
                self.sleep(self.retry.delay(attempt))
            except CompactionError:
                self.metrics.add("compaction_commit_failed_counter")
                raise
        raise AssertionError("unreachable")

    def _once(self, added: list, removed_paths: DataFrame, branch: str, operation: str) -> Table:
        table, p = self.load(), self.params
        table.check_schema(p.schema_id)
        start = table.metadata.snapshots.get(p.starting_snapshot_id)
        if start is None:
            raise ExecutionError(f"Snapshot {p.starting_snapshot_id} not found")
        head = table.metadata.snapshot_for(branch) or start
        live = table.entries(head.snapshot_id)
        removed = removed_files(live, removed_paths)
        row = removed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("r"), F.coalesce(F.sum("file_size_in_bytes"), F.lit(0)).alias("b")).first()
        wanted = removed_paths.distinct().count()
        if row["n"] != wanted:
            raise TableError(f"{wanted - row['n']} of {wanted} rewritten files are no longer in the table")
        if head.sequence_number > start.sequence_number:
            newer = live.where((F.col("content") == POSITION_DELETES) & (F.col("sequence_number") > start.sequence_number))
            if not newer.isEmpty():
                raise TableError("position deletes were committed during the rewrite")
        keep = custom_properties((start if p.use_starting_sequence_number else head).summary)
        sequence = start.sequence_number if p.use_starting_sequence_number else None
        dangling = self._dangling(table, live, removed_paths, sequence) if operation == "replace" else None
        gone = removed.unionByName(dangling) if dangling is not None else removed
        return table.commit_files(added, gone, DATA, branch, keep, operation=operation, sequence_number=sequence, removed_records=(row["n"], row["r"], row["b"]))

    @staticmethod
    def _dangling(table: Table, live: DataFrame, removed_paths: DataFrame, sequence: int | None) -> DataFrame:
        """Delete files that apply to no data file once the removed ones are gone and the new ones are there."""
        deletes = live.where(F.col("content") != DATA)
        stay = live.where(F.col("content") == DATA).join(removed_paths.select("file_path").distinct(), "file_path", "left_anti")
        oldest = stay.groupBy(F.coalesce("partition_key", F.lit("")).alias("k")).agg(F.min("sequence_number").alias("oldest"))
        local = deletes.join(oldest, F.coalesce(deletes["partition_key"], F.lit("")) == oldest["k"], "left")
        everywhere = stay.agg(F.min("sequence_number").alias("o")).first()["o"]
        seen = F.when(F.coalesce("partition_key", F.lit("")) == "", F.lit(everywhere).cast("long")).otherwise(F.col("oldest"))
        new = F.lit(sequence).cast("long") if sequence is not None else F.lit(None).cast("long")
        least = F.least(seen, F.when(F.col("content") == POSITION_DELETES, F.lit(None).cast("long")).otherwise(new))
        applies = F.when(F.col("content") == POSITION_DELETES, least <= F.col("sequence_number")).otherwise(least < F.col("sequence_number"))
        return local.where(~F.coalesce(applies, F.lit(False))).select(*deletes.columns)


def removed_files(live: DataFrame, paths: DataFrame) -> DataFrame:
    """The snapshot's entries of rewritten data files; delete files are not among them."""
    return live.where(F.col("content") == DATA).join(paths.select("file_path").distinct(), "file_path", "left_semi")


class _Runner:
    """What managed and automatic compaction share."""

    def __init__(self, catalog: Catalog, table_name: str, execution: ExecutionConfig | None, executor: Executor | None, registry: Registry | None, retry: RetryConfig, branch: str, catalog_name: str | None) -> None:
        self.catalog, self.table_name, self.execution = catalog, table_name, execution
        self.executor, self.retry, self.to_branch, self.catalog_name = executor or SparkExecutor(), retry, branch, catalog_name or catalog.name
        self.metrics = Metrics(registry, self.catalog_name, table_name)

    def load_table(self) -> Table:
        return self.catalog.load_table(self.table_name)

    def rewrite_plan(self, plan: CompactionPlan, config: ExecutionConfig, table: Table) -> RewriteResult:
        """Rewrites one plan, without committing."""
        if plan.to_branch != self.to_branch:
            raise ExecutionError(f"Compaction plan branch '{plan.to_branch}' does not match configured branch '{self.to_branch}'")
        if plan.snapshot_id not in table.metadata.snapshots:
            raise ExecutionError(f"Snapshot {plan.snapshot_id} not found")
        began = time.monotonic()
        try:
            response = self.executor.rewrite_files(RewriteRequest(table, plan, config))
        except Exception as e:
            self.metrics.add("compaction_executor_error_counter")
            raise e if isinstance(e, CompactionError) else ExecutionError(e) from e
        result = RewriteResult(response.data_files, response.stats, plan)
        self.metrics.plan(result.stats, (time.monotonic() - began) * 1000, sum(f.record_count for f in response.data_files))
        self.metrics.files([(f.record_count, f.file_size_in_bytes) for f in response.data_files], response.fetch_ms, response.write_ms)
        if config.enable_validate_compaction:
            rows = CompactionValidator(table, result, config, self.catalog_name).validate()
            result = replace(result, input_rows=rows[0], output_rows=rows[1])
        return result

    def concurrent_rewrite_plans(self, plans: Sequence[CompactionPlan], config: ExecutionConfig, table: Table) -> list[RewriteResult]:
        """All plans, some at a time; the first error is raised once all have ended."""
        with ThreadPoolExecutor(config.max_concurrent_compaction_plans) as pool:
            futures = [pool.submit(self.rewrite_plan, p, config, table) for p in plans]
        return [f.result() for f in futures]

    def build_commit_manager(self, params: CommitParams) -> CommitManager:
        return CommitManager(self.load_table, params, self.retry, self.metrics)

    def commit_rewrite_results(self, results: Sequence[RewriteResult]) -> Table:
        """All results in one snapshot."""
        if not results:
            raise ExecutionError("No rewrite results to commit")
        check_consistent(results, results[0].plan.snapshot_id, self.to_branch)
        table = self.load_table()
        snapshot = table.metadata.snapshots.get(results[0].plan.snapshot_id)
        if snapshot is None:
            raise ExecutionError(f"Snapshot {results[0].plan.snapshot_id} not found")
        return self.build_commit_manager(CommitParams(snapshot.snapshot_id, snapshot.schema_id)).rewrite_files_from_results(results, self.to_branch)

    def _finish(self, plans: Sequence[CompactionPlan], config: ExecutionConfig, table: Table, began: float) -> CompactionResult | None:
        plans = [p for p in plans if p.has_files()]
        if not plans:
            return None
        results = self.concurrent_rewrite_plans(plans, config, table)
        committed = self.commit_rewrite_results(results)
        merged = merge_rewrite_results(results, committed)
        self.metrics.rewrite(merged.stats)
        self.metrics.observe("compaction_duration", (time.monotonic() - began) * 1000)
        return merged


def merge_rewrite_results(results: Sequence[RewriteResult], table: Table | None = None) -> CompactionResult:
    return CompactionResult([f for r in results for f in r.output_files], merge_stats([r.stats for r in results]), table, list(results))


class Compaction(_Runner):
    """Managed compaction, or its steps one by one."""

    def __init__(self, catalog: Catalog, table_name: str, config: CompactionConfig | None = None, executor: Executor | None = None, registry: Registry | None = None, retry: RetryConfig = RetryConfig(), to_branch: str = MAIN, catalog_name: str | None = None) -> None:
        super().__init__(catalog, table_name, config.execution if config else None, executor, registry, retry, to_branch, catalog_name)
        self.config = config

    def _needed(self) -> CompactionConfig:
        if self.config is None:
            raise ExecutionError("CompactionConfig is required")
        return self.config

    def plan_compaction(self) -> list[CompactionPlan]:
        return CompactionPlanner(self._needed().planning).plan_compaction_with_branch(self.load_table(), self.to_branch)

    def compact(self) -> CompactionResult | None:
        """Plan, rewrite, validate, commit once; None if there is nothing to do."""
        config, began = self._needed(), time.monotonic()
        return self._finish(self.plan_compaction(), config.execution, self.load_table(), began)

    def compact_with_plan(self, plan: CompactionPlan, config: ExecutionConfig) -> CompactionResult | None:
        """One plan from rewrite to commit; None if it has no files."""
        if plan.file_count() == 0:
            return None
        return self._finish([plan], config, self.load_table(), time.monotonic())


class CompactionBuilder:
    """Builds a Compaction step by step."""

    def __init__(self, catalog: Catalog, table_name: str) -> None:
        self.catalog, self.table_name, self.options = catalog, table_name, {}

    def _with(self, **options) -> CompactionBuilder:
        self.options |= options
        return self

    def with_config(self, config: CompactionConfig) -> CompactionBuilder:
        return self._with(config=config)

    def with_executor(self, executor: Executor) -> CompactionBuilder:
        return self._with(executor=executor)

    def with_catalog_name(self, name: str) -> CompactionBuilder:
        return self._with(catalog_name=name)

    def with_registry(self, registry: Registry) -> CompactionBuilder:
        return self._with(registry=registry)

    def with_retry_config(self, retry: RetryConfig) -> CompactionBuilder:
        return self._with(retry=retry)

    def with_to_branch(self, branch: str) -> CompactionBuilder:
        return self._with(to_branch=branch)

    def build(self) -> Compaction:
        return Compaction(self.catalog, self.table_name, **self.options)


class AutoCompaction(_Runner):
    """Compaction with plans of the automatic planner."""

    def __init__(self, catalog: Catalog, table_name: str, config: AutoCompactionConfig = AutoCompactionConfig(), executor: Executor | None = None, registry: Registry | None = None, retry: RetryConfig = RetryConfig(), to_branch: str = MAIN, catalog_name: str | None = None) -> None:
        super().__init__(catalog, table_name, config.execution, executor, registry, retry, to_branch, catalog_name)
        self.config = config

    def compact(self) -> CompactionResult | None:
        began, table = time.monotonic(), self.load_table()
        report = AutoCompactionPlanner(self.config).plan_compaction_report_with_branch(table, self.to_branch)
        return self._finish(report.plans, self.config.execution, table, began)
