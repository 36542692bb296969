"""Filters on files and on groups of files. Each is a step from DataFrame to DataFrame; they compose by AND."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20


class FileFilter(Protocol):
    """Keeps files; any object with filter() will do."""

    def filter(self, files: DataFrame) -> DataFrame: ...


class GroupFilter(Protocol):
    """Keeps groups, given a row of totals for each."""

    def filter(self, groups: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SizeFilter:
    """Files of at least `min_size` and less than `max_size` bytes, by the length to read."""

    min_size: int | None = None
    max_size: int | None = None

    def filter(self, files: DataFrame) -> DataFrame:
        if self.min_size is not None:
            files = files.where(F.col("length") >= self.min_size)
        return files if self.max_size is None else files.where(F.col("length") < self.max_size)

    def __str__(self) -> str:
        low, high = (None if x is None else x // MIB for x in (self.min_size, self.max_size))
        if low is None and high is None:
            return "SizeFilter[Any]"
        return f"SizeFilter[<{high}MB]" if low is None else f"SizeFilter[>{low}MB]" if high is None else f"SizeFilter[{low}-{high}MB]"


@dataclass(frozen=True)
class DeleteFileCountFilter:
    """Files to which at least so many delete files apply."""

    min_count: int

    def filter(self, files: DataFrame) -> DataFrame:
        return files.where(F.size("deletes") >= self.min_count)

    def __str__(self) -> str:
        return f"DeleteFileCountFilter[>={self.min_count} deletes]"


@dataclass(frozen=True)
class MinGroupSize:
    """Groups whose data files have at least so many bytes to read."""

    min_bytes: int

    def filter(self, groups: DataFrame) -> DataFrame:
        return groups.where(F.col("total_size") >= self.min_bytes)

    def __str__(self) -> str:
        return f"MinGroupSize[{self.min_bytes // MIB}MB]"


@dataclass(frozen=True)
class MinGroupFileCount:
    """Groups with at least so many data files."""

    min_count: int

    def filter(self, groups: DataFrame) -> DataFrame:
        return groups.where(F.col("data_file_count") >= self.min_count)

    def __str__(self) -> str:
        return f"MinGroupFileCount[{self.min_count}]"
