"""Validation of a rewrite before it is committed: row count, and an order-free hash of all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError, ValidationError
from millrace.model import RewriteResult
from millrace.operators.rewrite import read_group
from millrace.plans.config import ExecutionConfig
from millrace.sources.files import read_files
from millrace.sources.table import Table


def digest(df: DataFrame, side: str) -> DataFrame:
    """One row: side, rows, hash - the sum of row hashes, whatever the order; floats of either zero are equal."""
    plain = [F.col(f"`{f.name}`") + F.lit(0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.select(F.xxhash64(*plain).cast("decimal(38,0)").alias("h")).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("hash"))


def same_schema(input_id: int, output_id: int) -> None:
    if input_id != output_id:
        raise ConfigError("Input and output schemas must be the same for validation")


class CompactionValidator:
    """Compares a plan's input, after deletes, with what was written for it."""

    def __init__(self, table: Table, result: RewriteResult, config: ExecutionConfig, catalog_name: str = "default") -> None:
        self.table, self.result, self.config, self.catalog_name = table, result, config, catalog_name

    def validate(self) -> tuple[int, int]:
        """(input rows, output rows); raises if they or the hashes differ. Both sides are one job."""
        t = self.table
        before = digest(read_group(t, self.result.plan.files, self.config), "input")
        after = digest(read_files(t.spark, t.metadata.schema(), [f.file_path for f in self.result.output_files]), "output")
        got = {r["side"]: r for r in before.union(after).collect()}
        rows = got["input"]["rows"], got["output"]["rows"]
        if rows[0] != rows[1]:
            raise ValidationError(f"Input and output row count mismatch: {rows[0]} != {rows[1]} for catalog '{self.catalog_name}' table_ident '{t.name}'")
        if got["input"]["hash"] != got["output"]["hash"]:
            raise ValidationError(f"Input and output rows differ for catalog '{self.catalog_name}' table_ident '{t.name}'")
        return rows


def written_inputs(tasks: DataFrame, output_paths: DataFrame) -> DataFrame:
    """Scan tasks whose file is among the output paths (column file_path): a semi join."""
    return tasks.join(output_paths.select("file_path"), "file_path", "left_semi")
