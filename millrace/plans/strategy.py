"""File selection: file filters, grouping, group filters, parallelism - in this order.

All of it is on the planning DataFrame (model.FILE_TASK). A group is not a collected list: every file row gets a
`group_id`, and one row of totals is kept for each group, so a table of millions of files is planned with
partial sums. Only bin-packing is sequential by nature: it gets path and size of one scope's files in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sizing import parallelism_cols
from millrace.model import EQUALITY_DELETES, POSITION_DELETES, FileGroup
from millrace.plans.config import BinPackConfig, FileGroupScope, FilesWithDeletesConfig, FullCompactionConfig, GroupFilters, Grouping, PlanningConfig, SmallFilesConfig
from millrace.plans.filters import DeleteFileCountFilter, FileFilter, GroupFilter, MinGroupFileCount, MinGroupSize, SizeFilter
from millrace.plans.packer import ListPacker

MIB = 1 << 20


def with_scope(files: DataFrame, scope: FileGroupScope) -> DataFrame:
    """`scope`: the partition (null and empty are one), or one value for the table."""
    return files.withColumn("scope", F.coalesce("partition_key", F.lit("")) if scope is FileGroupScope.PARTITION else F.lit(""))


@dataclass(frozen=True)
class SingleGrouping:
    """All files of a scope."""

    def assign(self, files: DataFrame) -> DataFrame:
        return files.withColumn("bin", F.lit(0))

    def __str__(self) -> str:
        return "SingleGrouping"


@dataclass(frozen=True)
class BinPackGrouping:
    """Bins of at most `target` bytes of whole files, largest first (ties by path), newest bin or a new one."""

    target: int
    lookback: int = 1

    def assign(self, files: DataFrame) -> DataFrame:
        packer = ListPacker(self.target, self.lookback)

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["file_size_in_bytes", "file_path"], ascending=[False, True], kind="stable", ignore_index=True)
            return rows[["scope", "file_path"]].assign(bin=packer.assign(rows["file_size_in_bytes"].tolist()))

        bins = files.select("scope", "file_path", "file_size_in_bytes").groupBy("scope").applyInPandas(pack, "scope string, file_path string, bin int")
        return files.join(bins, ["scope", "file_path"])

    def __str__(self) -> str:
        return f"BinPackGrouping[target={self.target // MIB}MB]"


def grouping_of(config: Grouping) -> SingleGrouping | BinPackGrouping:
    return BinPackGrouping(config.target_group_size_bytes) if isinstance(config, BinPackConfig) else SingleGrouping()


def delete_files(assigned: DataFrame) -> DataFrame:
    """group_id, content, path, bytes: the delete files of each group, every path once (with its smallest size)."""
    each = assigned.select("group_id", F.explode("deletes").alias("d")).groupBy("group_id", F.col("d.content").alias("content"), F.col("d.file_path").alias("path"))
    return each.agg(F.min("d.file_size_in_bytes").alias("bytes"))


def group_totals(assigned: DataFrame) -> DataFrame:
    """One row a group: totals of its data files, and of its delete files."""
    data = assigned.groupBy("group_id", "scope").agg(
        F.sum("length").cast("long").alias("total_size"), F.count(F.lit(1)).alias("data_file_count"), F.sum("file_size_in_bytes").cast("long").alias("data_bytes")
    )
    kind = lambda c: F.col("content") == c
    total = lambda c: F.coalesce(F.sum(F.when(kind(c), F.col("bytes"))), F.lit(0)).cast("long")
    deletes = delete_files(assigned).groupBy("group_id").agg(
        F.count_if(kind(POSITION_DELETES)).alias("position_delete_file_count"),
        F.count_if(kind(EQUALITY_DELETES)).alias("equality_delete_file_count"),
        total(POSITION_DELETES).alias("position_delete_bytes"),
        total(EQUALITY_DELETES).alias("equality_delete_bytes"),
    )
    zero = ["position_delete_file_count", "equality_delete_file_count", "position_delete_bytes", "equality_delete_bytes"]
    out = data.join(deletes, "group_id", "left").fillna(0, zero)
    return out.withColumns(
        {
            "input_files_count": F.col("data_file_count") + F.col("position_delete_file_count") + F.col("equality_delete_file_count"),
            "input_total_bytes": F.col("data_bytes") + F.col("position_delete_bytes") + F.col("equality_delete_bytes"),
        }
    )


@dataclass(frozen=True)
class PlanStrategy:
    """A pipeline of filters and a grouping; `str` describes it."""

    config: FullCompactionConfig
    file_filters: Sequence[FileFilter] = ()
    grouping: SingleGrouping | BinPackGrouping = SingleGrouping()
    group_filters: Sequence[GroupFilter] = ()
    scope: FileGroupScope = FileGroupScope.PARTITION

    def select(self, files: DataFrame) -> DataFrame:
        for f in self.file_filters:
            files = f.filter(files)
        return files

    def assign(self, files: DataFrame) -> DataFrame:
        """Selected files with `scope`, `bin` and `group_id`."""
        placed = self.grouping.assign(with_scope(self.select(files), self.scope))
        return placed.withColumn("group_id", F.concat_ws("#", "scope", F.col("bin").cast("string")))

    def groups(self, assigned: DataFrame) -> DataFrame:
        """One row for each group that passes, with its totals and parallelism."""
        totals = group_totals(assigned)
        for f in self.group_filters:
            totals = f.filter(totals)
        into, out = parallelism_cols(F.col("input_total_bytes"), F.col("input_files_count"), F.col("data_bytes"), self.config)
        return totals.withColumns({"executor_parallelism": into, "output_parallelism": out})

    def execute(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(files with group_id, groups): only files of groups that pass."""
        assigned = self.assign(files)
        groups = self.groups(assigned)
        return assigned.join(groups.select("group_id"), "group_id", "left_semi"), groups

    def __str__(self) -> str:
        parts = [" -> ".join(map(str, self.file_filters)) or "NoFileFilters", str(self.grouping), " -> ".join(map(str, self.group_filters)) or "NoGroupFilters"]
        if self.scope is FileGroupScope.TABLE:
            parts.insert(1, "Table")
        return " -> ".join(parts)


def group_filters_of(config: GroupFilters) -> tuple[GroupFilter, ...]:
    """Size first, then count; a bound of 0 is none."""
    size, count = config.min_group_size_bytes, config.min_group_file_count
    return (*([MinGroupSize(size)] if size else []), *([MinGroupFileCount(count)] if count else []))


def strategy_of(config: PlanningConfig) -> PlanStrategy:
    """The pipeline of a planning config."""
    base = {"config": config, "grouping": grouping_of(config.grouping_strategy), "scope": config.file_group_scope}
    if isinstance(config, SmallFilesConfig):
        return PlanStrategy(file_filters=(SizeFilter(max_size=config.small_file_threshold_bytes),), group_filters=group_filters_of(config.group_filters), **base)
    if isinstance(config, FilesWithDeletesConfig):
        least = config.min_delete_file_count_threshold
        return PlanStrategy(file_filters=(DeleteFileCountFilter(least),) if least > 0 else (), group_filters=group_filters_of(config.group_filters), **base)
    return PlanStrategy(**base)


def group_of(row) -> FileGroup:
    names = FileGroup.__dataclass_fields__
    d = row.asDict()
    return FileGroup(**{n: d[n] for n in names if n in d and n != "partition_key"}, partition_key=d["scope"])


