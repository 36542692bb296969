"""Scans: an explicit list of files as a DataFrame, with hidden columns where deletes need them.

Row positions come from Spark's `_metadata.row_index`, which counts within the file however it is split. Sequence
numbers are a file's, not a row's: files are grouped by sequence number, and each group's scan adds a constant, so no
join is needed; with many different numbers the planner's rows are joined on the path instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import DATA, EQUALITY_DELETES, PATH, POSITION, POSITION_DELETES, SEQUENCE
from millrace.plans.packer import split_balanced

#: Beyond so many sequence numbers in a scan, they are joined on the path.
MOST_UNIONED = 16


def canonical(path: Column | str) -> Column:
    """file:/x and file:///x are one path; percent signs are decoded as Spark's metadata encodes them."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def read_files(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The files as one table; columns that an old file lacks are null."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def register(spark: SparkSession, name: str, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The same, as a temporary view too."""
    df = read_files(spark, schema, paths)
    df.createOrReplaceTempView(name)
    return df


def with_positions(df: DataFrame) -> DataFrame:
    """Adds the row's file and its place in it, from 0."""
    return df.select("*", canonical("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(POSITION))


def data_scan(spark: SparkSession, schema: T.StructType, files: Sequence[tuple[str, int]], positions: bool, sequences: bool) -> DataFrame:
    """Data files (path, sequence number) with the hidden columns asked for."""
    numbers = sorted({n for _, n in files}) if sequences else []
    add = with_positions if positions else lambda df: df
    if not sequences or not files:
        df = add(read_files(spark, schema, [p for p, _ in files])) if files else _empty(spark, schema, positions)
        return df.withColumn(SEQUENCE, F.lit(None).cast("long")) if sequences else df
    if len(numbers) <= MOST_UNIONED:
        parts = [add(read_files(spark, schema, [p for p, m in files if m == n])).withColumn(SEQUENCE, F.lit(n).cast("long")) for n in numbers]
        return reduce(DataFrame.unionByName, parts)
    known = spark.createDataFrame(list(files), f"`{PATH}` string, `{SEQUENCE}` long").withColumn(PATH, canonical(PATH))
    df = with_positions(read_files(spark, schema, [p for p, _ in files])).join(known, PATH)
    return df if positions else df.drop(PATH, POSITION)


def scoped_scan(spark: SparkSession, schema: T.StructType, files: Sequence[tuple[str, int, Sequence[str]]], scope: str) -> DataFrame:
    """Files (path, sequence number, scopes) with positions and sequence numbers, and a row for each scope of the file. One scan, whatever the number of files
    and scopes: what belongs to a file is joined on its path."""
    known = spark.createDataFrame([(p, n, list(k)) for p, n, k in files], f"`{PATH}` string, `{SEQUENCE}` long, `{scope}` array<string>")
    known = known.select(canonical(PATH).alias(PATH), SEQUENCE, F.explode(scope).alias(scope))
    return with_positions(read_files(spark, schema, [p for p, _, _ in files])).join(known, PATH)


def _empty(spark: SparkSession, schema: T.StructType, positions: bool) -> DataFrame:
    df = spark.createDataFrame([], schema)
    return df.select("*", F.lit(None).cast("string").alias(PATH), F.lit(None).cast("long").alias(POSITION)) if positions else df


#: How position-delete files are stored.
POSITION_DELETE_SCHEMA = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("pos", T.LongType())])


def position_deletes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, position) rows of position-delete files."""
    return read_files(spark, POSITION_DELETE_SCHEMA, paths).select(canonical("file_path").alias(PATH), F.col("pos").alias(POSITION))


def equality_deletes(spark: SparkSession, schema: T.StructType, files: Sequence[tuple[str, int]]) -> DataFrame:
    """Rows of equality-delete files with their sequence number; schema has the id columns."""
    return data_scan(spark, schema, files, positions=False, sequences=True)


def data_files(files: DataFrame) -> DataFrame:
    """The data files of a snapshot's file list."""
    return files.where(F.col("content") == DATA)


def by_content(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data files, delete files) of a file list."""
    return files.where(F.col("content") == DATA), files.where(F.col("content").isin(POSITION_DELETES, EQUALITY_DELETES))


def balanced(files: DataFrame, n: int, order: Sequence[str] = ("file_path",)) -> DataFrame:
    """files with `split`: dealt in order to n splits of about equal length. Sequential, so in one task; only path and length go there."""

    def deal(rows):
        rows = rows.sort_values(list(order), kind="stable", ignore_index=True)
        split = [0] * len(rows)
        for k, indices in enumerate(split_balanced(rows["length"].tolist(), n)):
            for i in indices:
                split[i] = k
        return rows[["file_path"]].assign(split=split)

    rows = files.select(*dict.fromkeys(["file_path", "length", *order]), F.lit(0).alias("all_of_them"))
    dealt = rows.groupBy("all_of_them").applyInPandas(deal, "file_path string, split int")
    return files.join(dealt, "file_path")
