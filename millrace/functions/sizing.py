"""How many files a rewrite should make and how it should be split.

Each function exists for Python integers and, with the suffix _col, as a column expression that
gives the same value in the planner's DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ExecutionError
from millrace.plans.config import SPLIT_OVERHEAD, FullCompactionConfig


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def min_file_size(target: int) -> int:
    """A rest above this is worth a file of its own."""
    return target * 3 // 4


def max_file_size(target: int) -> int:
    return target * 9 // 5


def write_max_file_size(target: int) -> int:
    """How large a file may get before another is begun."""
    return target + (max_file_size(target) - target) // 2


def expected_output_files(input_bytes: int, target: int) -> int:
    if target == 0 or input_bytes < target:
        return 1
    down, rest = divmod(input_bytes, target)
    if rest > min_file_size(target):
        return ceil_div(input_bytes, target)
    return down if input_bytes // down <= min(target * 11 // 10, write_max_file_size(target)) else ceil_div(input_bytes, target)


def input_split_size(input_bytes: int, target: int) -> int:
    if target == 0:
        return input_bytes + SPLIT_OVERHEAD
    split = input_bytes // expected_output_files(input_bytes, target) + SPLIT_OVERHEAD
    return target if split < target else min(split, write_max_file_size(target))


def output_parallelism_heuristic(parallelism: int, data_bytes: int, target: int, enabled: bool = True) -> int:
    """One writer if all data fit in one file."""
    return 1 if enabled and parallelism > 1 and 0 < data_bytes < target else parallelism


def parallelism(input_bytes: int, input_files: int, data_bytes: int, config: FullCompactionConfig) -> tuple[int, int]:
    """(input, output) parallelism of a group. Bytes and files count delete files as well; data_bytes doesn't."""
    if input_bytes == 0:
        raise ExecutionError("No files to calculate task parallelism")
    target = config.target_file_size_bytes
    out = max(1, min(expected_output_files(input_bytes, target), config.max_output_parallelism))
    out = output_parallelism_heuristic(out, data_bytes, target, config.enable_heuristic_output_parallelism)
    by_size, by_count = ceil_div(input_bytes, input_split_size(input_bytes, target)), ceil_div(input_files, config.max_file_count_per_partition)
    return min(max(by_size, by_count), config.max_input_parallelism), out


def _int_div(a: Column, b: Column | int) -> Column:
    """a div b for non-negative longs, without going through doubles."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return ((a - a % b) / b).cast("long")


def _up(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return _int_div(a + b - 1, b)


def expected_output_files_col(input_bytes: Column, target: int) -> Column:
    if target == 0:
        return F.lit(1).cast("long")
    one = F.lit(1).cast("long")
    down = F.greatest(_int_div(input_bytes, target), one)
    most = min(target * 11 // 10, write_max_file_size(target))
    return (
        F.when(input_bytes < target, one)
        .when(input_bytes % target > min_file_size(target), _up(input_bytes, target))
        .when(_int_div(input_bytes, down) <= most, down)
        .otherwise(_up(input_bytes, target))
    )


def input_split_size_col(input_bytes: Column, target: int) -> Column:
    if target == 0:
        return input_bytes + SPLIT_OVERHEAD
    split = _int_div(input_bytes, expected_output_files_col(input_bytes, target)) + SPLIT_OVERHEAD
    return F.when(split < target, F.lit(target).cast("long")).otherwise(F.least(split, F.lit(write_max_file_size(target)).cast("long")))


def output_parallelism_heuristic_col(parallelism_: Column, data_bytes: Column, target: int, enabled: bool = True) -> Column:
    one_file = (parallelism_ > 1) & (data_bytes > 0) & (data_bytes < target)
    return F.when(one_file, F.lit(1).cast("long")).otherwise(parallelism_) if enabled else parallelism_


def parallelism_cols(input_bytes: Column, input_files: Column, data_bytes: Column, config: FullCompactionConfig) -> tuple[Column, Column]:
    """(input, output) parallelism as columns; a group without bytes is an error."""
    target = config.target_file_size_bytes
    checked = F.when(input_bytes == 0, F.raise_error(F.lit("No files to calculate task parallelism")).cast("long")).otherwise(input_bytes)
    out = F.greatest(F.lit(1).cast("long"), F.least(expected_output_files_col(checked, target), F.lit(config.max_output_parallelism).cast("long")))
    out = output_parallelism_heuristic_col(out, data_bytes, target, config.enable_heuristic_output_parallelism)
    by_size, by_count = _up(checked, input_split_size_col(checked, target)), _up(input_files.cast("long"), config.max_file_count_per_partition)
    return F.least(F.greatest(by_size, by_count), F.lit(config.max_input_parallelism).cast("long")), out
