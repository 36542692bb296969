"""Seeded test tables: data files, and delete files of both kinds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError
from millrace.model import PATH, POSITION
from millrace.sources.files import with_positions
from millrace.sources.table import Catalog, Table

#: Type names of a table's description.
TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "varchar": T.StringType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
}


def type_of(name: str) -> T.DataType:
    """varchar(20) is a string of 20 characters at most."""
    base = name.partition("(")[0].strip().lower()
    if base not in TYPES:
        raise ConfigError(f"unknown type {name}")
    return TYPES[base]


def random_column(kind: T.DataType, key: Column, seed: int, most: int = 20) -> Column:
    """A value that follows from the row's key and the seed."""
    h = F.xxhash64(key, F.lit(seed))
    if isinstance(kind, T.StringType):
        return F.substring(F.sha2(h.cast("string"), 256), 1, F.pmod(h, F.lit(most + 1)).cast("int"))
    if isinstance(kind, T.BooleanType):
        return F.pmod(h, F.lit(2)) == 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.pmod(h, F.lit(1_000_003)) / 1000).cast(kind)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 62}[type(kind)]
        return F.pmod(h, F.lit(1 << bits)).cast(kind)
    raise ConfigError(f"no generator for {kind.simpleString()}")


def generate(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 0, start: int = 0) -> DataFrame:
    """Rows start .. start + rows - 1 of an endless table of this schema and seed."""
    key = F.col("__key")
    frame = spark.range(start, start + rows).withColumnRenamed("id", "__key")
    return frame.select(*[random_column(f.dataType, key, seed * 1000 + i).alias(f.name) for i, f in enumerate(schema.fields)])


@dataclass(frozen=True)
class MockTable:
    """What to make: files of so many rows, with so many rows of each deleted by position and by key."""

    columns: Sequence[tuple[str, str]] = (("v1", "int"), ("v2", "bigint"), ("v3", "varchar(20)"))
    key: Sequence[str] = ("v1", "v2")
    files: int = 5
    rows_per_file: int = 10_000
    equality_deletes_per_file: int = 100
    position_deletes_per_file: int = 100
    seed: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, type_of(k)) for n, k in self.columns])


def every(rows: int, deletes: int) -> int:
    """Which rows are deleted: each of this number."""
    return rows // deletes + 1


def mock_table(catalog: Catalog, name: str, spec: MockTable = MockTable()) -> Table:
    """A table of data files; then one commit of position deletes, then one of equality deletes."""
    spark, schema = catalog.spark, spec.schema
    table = catalog.create_table(name, schema)
    parts = [generate(spark, schema, spec.rows_per_file, spec.seed, i * spec.rows_per_file).coalesce(1) for i in range(spec.files)]
    for part in parts:
        table = table.append(part)
    if spec.position_deletes_per_file:
        k = every(spec.rows_per_file, spec.position_deletes_per_file)
        paths = [r[0] for r in table.entries(table.metadata.refs["main"]).select("file_path").collect()]
        rows = with_positions(spark.read.schema(schema).parquet(*paths)).where(F.col(POSITION) % k == 0)
        table = table.delete_positions(rows.select(F.col(PATH).alias("file_path"), F.col(POSITION).alias("pos")))
    if spec.equality_deletes_per_file:
        k = every(spec.rows_per_file, spec.equality_deletes_per_file)
        keys = None
        for i in range(spec.files):
            some = generate(spark, schema, spec.rows_per_file, spec.seed, i * spec.rows_per_file)
            some = some.select(*spec.key).where(F.pmod(F.xxhash64(*spec.key), F.lit(k)) == 0)
            keys = some if keys is None else keys.union(some)
        table = table.delete_equal(keys, list(spec.key))
    return table


def split_by_operation(rows: DataFrame, operation: str = "op", insert: int = 1, delete: int = 2) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, deleted rows) of a change feed."""
    return rows.where(F.col(operation) == insert).drop(operation), rows.where(F.col(operation) == delete).drop(operation)
