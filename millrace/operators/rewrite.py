"""The rewrite of one plan: read with deletes applied, sort, write new files, report.

Rows are dealt round-robin to the group's output parallelism before the sort, within their partition if there are several; each
task's rows are sorted on their own, with no global order. Files are cut at the target size by rows: Spark's writers roll by row count, so
the count comes from the input's bytes per row.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError
from millrace.model import EQUALITY_DELETES, POSITION_DELETES, SEQUENCE, CompactionPlan, DataFile, FileGroup, RewriteStats
from millrace.operators.merge_on_read import EqualityDeletes, MergeOnRead, equality_columns
from millrace.plans.config import ExecutionConfig
from millrace.sources.files import data_scan, equality_deletes, position_deletes, scoped_scan
from millrace.sources.table import SortField, Table

SCOPE = "sys_hidden_partition"


def sort_columns(schema: T.StructType, fields: tuple[SortField, ...] | list[SortField]) -> list[Column]:
    """The table's sort order as columns: identity transforms only; fields that the schema lacks are left out."""
    out = []
    for f in fields:
        if f.transform != "identity":
            raise ConfigError("only identity sort transforms are supported")
        if f.column in schema.fieldNames():
            c = F.col(f"`{f.column}`")
            out.append({(True, True): c.asc_nulls_first, (True, False): c.asc_nulls_last, (False, True): c.desc_nulls_first, (False, False): c.desc_nulls_last}[f.ascending, f.nulls_first]())
    return out


def merge_query(table: Table, files: DataFrame, config: ExecutionConfig = ExecutionConfig()) -> MergeOnRead:
    """The merge-on-read query over the rows of a group (FILE_TASK). The driver gets the group's descriptors, as it must name files to Spark."""
    spark, schema, ids = table.spark, table.metadata.schema(), table.metadata.field_ids()
    data = [(r["file_path"], r["sequence_number"], r["partition_key"] or "") for r in files.select("file_path", "sequence_number", "partition_key").collect()]
    partitioned = bool(table.metadata.partition_fields)
    keys = files.select(F.coalesce("partition_key", F.lit("")).alias("key"), F.explode("deletes").alias("d"))
    deletes = keys.groupBy(F.col("d.file_path").alias("path")).agg(F.first("d").alias("d"), F.collect_set("key").alias("keys")).collect()
    pos = [(r["path"], r["d"]["file_size_in_bytes"]) for r in deletes if r["d"]["content"] == POSITION_DELETES]
    by_ids: dict[tuple[int, ...], list] = {}
    for r in deletes:
        if r["d"]["content"] == EQUALITY_DELETES:
            by_ids.setdefault(tuple(sorted(r["d"]["equality_ids"] or ())), []).append(r)
    several = partitioned and len({k for _, _, k in data}) > 1 and bool(by_ids)
    if several:  # a delete only hits the partitions whose files it was planned for
        scan = scoped_scan(spark, schema, [(p, s, [k]) for p, s, k in data], SCOPE)
    else:
        scan = data_scan(spark, schema, [(p, s) for p, s, _ in data], bool(pos), bool(by_ids))
    equality = []
    for group, rows in by_ids.items():
        columns = equality_columns(ids, group)
        part = T.StructType([schema[c] for c in columns])
        if several:
            frame = scoped_scan(spark, part, [(r["path"], r["d"]["sequence_number"], sorted(r["keys"])) for r in rows], SCOPE)
        else:
            frame = equality_deletes(spark, part, [(r["path"], r["d"]["sequence_number"]) for r in rows])
        # of equal delete rows the newest is enough
        by = [f"`{c}`" for c in columns] + ([SCOPE] if several else [])
        frame = frame.groupBy(*by).agg(F.max(SEQUENCE).alias(SEQUENCE))
        equality.append(EqualityDeletes(columns, frame, sum(r["d"]["file_size_in_bytes"] for r in rows) <= config.broadcast_deletes_bytes))
    return MergeOnRead(
        schema.fieldNames(), scan, position_deletes(spark, [p for p, _ in pos]).distinct() if pos else None, sum(n for _, n in pos) <= config.broadcast_deletes_bytes, equality,
        config.null_safe_equality_deletes, SCOPE if several else None,
    )


def read_group(table: Table, files: DataFrame, config: ExecutionConfig = ExecutionConfig()) -> DataFrame:
    """The group's rows, deletes applied."""
    return merge_query(table, files, config).frame()


def rows_per_file(group: FileGroup, records: int, target: int) -> int:
    """How many rows make a file of the target size, by the input's bytes per row; 0 is no limit."""
    if not group.data_bytes or not records or group.data_bytes <= target:
        return 0
    return max(1, math.ceil(target * records / group.data_bytes))


def arranged(df: DataFrame, table: Table, group: FileGroup, partitions: int = 1) -> tuple[DataFrame, list[str]]:
    """Dealt to the group's output parallelism and sorted in each task, for a group of so many table partitions; with the names of its partition columns.

    These stay in the frame: Spark's writer then sees that rows are in order of them, and does not sort again.
    """
    wide, names = table.partitioned(df)
    by, n = [F.col(x) for x in names], group.output_parallelism
    if n == 1:
        wide = wide.coalesce(1)
    elif partitions == 1:  # one partition, or a table without: the group is one key, so rows are dealt round-robin
        wide = wide.repartition(n)
    else:  # each partition in as many tasks as there are for one, so that it gets few files and none is a single task's
        ways = max(1, math.ceil(n / partitions))
        wide = wide.repartition(n, *by, F.pmod(F.monotonically_increasing_id(), F.lit(ways)))
    order = sort_columns(table.metadata.schema(), table.metadata.sort_fields)
    if order:
        wide = wide.sortWithinPartitions(*by, *order)
    return wide, names


@dataclass(frozen=True)
class RewriteRequest:
    table: Table
    plan: CompactionPlan
    config: ExecutionConfig


@dataclass(frozen=True)
class RewriteResponse:
    data_files: list[DataFile]
    stats: RewriteStats
    input_rows: int | None = None
    fetch_ms: float = 0.0  # to get the plan's descriptors
    write_ms: float = 0.0


class Executor(Protocol):
    """Rewrites one plan. Any object with rewrite_files() will do."""

    def rewrite_files(self, request: RewriteRequest) -> RewriteResponse: ...


class SparkExecutor:
    """One Spark job for each plan."""

    def rewrite_files(self, request: RewriteRequest) -> RewriteResponse:
        table, plan, config = request.table, request.plan, request.config
        began = time.monotonic()
        size = plan.files.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.count_distinct(F.coalesce("partition_key", F.lit(""))).alias("partitions")).first()
        df, names = arranged(read_group(table, plan.files, config), table, plan.group, max(1, size["partitions"]))
        options = {"compression": config.compression, "parquet.block.size": str(config.row_group_bytes)}
        if most := rows_per_file(plan.group, size["records"], config.target_file_size_bytes):
            options["maxRecordsPerFile"] = str(most)
        read = time.monotonic()
        files = table.write_files(df, prefix=f"{config.data_file_prefix}-{uuid.uuid4().hex[:8]}", options=options, partition_columns=names)
        return RewriteResponse(files, RewriteStats.of(plan.group, files), fetch_ms=(read - began) * 1000, write_ms=(time.monotonic() - read) * 1000)


class MockExecutor:
    """Writes nothing."""

    def rewrite_files(self, request: RewriteRequest) -> RewriteResponse:
        return RewriteResponse([], RewriteStats())

