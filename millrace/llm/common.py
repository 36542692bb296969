"""What the operators of this package share: reading, cutting lineage, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import shared_folder

#: Rows and bytes in one Arrow batch that goes to a Python worker, whichever comes first: texts can be long.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the user stays.

    Workers on this machine also learn where this package lies, should the session have
    started in another folder. On a cluster it is shipped as usual (--py-files or an image).
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Lineage ends at files that outlive any executor, and what the table holds is
    computed once however often it is read. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a table that cut() made and that nothing reads any more."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _WRITTEN if any(p.endswith(e[1].rsplit("/", 1)[1]) for p in paths)]:
        _WRITTEN.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


def smallest(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """The rows whose keys have the smallest hashes, one for a key and at most `most` in all; null keys are left out. None if there are none."""
    hashed = F.xxhash64(F.col(f"`{key}`"))
    known = rows.where(F.col(f"`{key}`").isNotNull())
    end = known.select(hashed.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return None if end is None else known.where(hashed <= end).dropDuplicates([key])


#: A key is hot if it has more than this share of a table's rows; so there are no more hot keys than this.
MOST_HOT = 4096


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, counts: DataFrame, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """left joined with right on key, where one key may have any share of left's rows and has one row of right.

    Hot keys' rows are dealt by a hash of the column `by` to as many tasks as it takes, and their rows of right are
    repeated for each. counts: key, n - how many rows of left a key has; total: how many left has (or a bound). Hot keys come
    to the driver: MOST_HOT of them at most. Keys must not be null.
    """
    keys = [key] if isinstance(key, str) else key
    part = max(least, total // MOST_HOT)
    hot = counts.where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).cast("int").alias("spread_ways"))
    rows = hot.collect()
    if not rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))  # at most total / part rows
    ways = F.coalesce("spread_ways", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("spread", F.pmod(F.xxhash64(by), ways).cast("int")).drop("spread_ways")
    each = right.join(hot, keys, "left").withColumn("spread", F.explode(F.sequence(F.lit(0), ways - 1))).drop("spread_ways")
    return dealt.join(each, [*keys, "spread"], how).drop("spread")


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, kept for the next tasks of this Python process; only one name's at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def tidy(keep: str | None = None) -> None:
    """Gives memory of a Python worker back to the system: workers live on after a task, next to an executor's heap."""
    for name in [n for n in _HELD if n != keep]:
        del _HELD[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[dict], dict]], keep: str | None = None) -> DataFrame:
    """Arrow in, Arrow out: make() runs once in each Python worker task and gives the
    function from a dict of column lists to a dict of column lists of the result.

    Only `columns` reach Python, so other columns, whatever their names, do no harm. keep: what make() holds for other tasks.
    """
    out_schema = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        work = make()
        for batch in batches:
            if batch.num_rows:
                got = work({name: batch.column(i).to_pylist() for i, name in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)
        del work
        tidy(keep)

    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def sum_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], tuple[Callable[[dict], bool], Callable[[], dict]]]) -> DataFrame:
    """Like map_rows, for sums over many batches: make() gives (add, rest). add takes a batch and tells whether it holds
    so much that it must be handed out; rest gives what is held, as columns of the result, and forgets it."""
    out_schema = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        add, rest = make()
        handed = lambda got: pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)
        for batch in batches:
            if batch.num_rows and add({name: batch.column(i).to_pylist() for i, name in enumerate(columns)}):
                yield handed(rest())
        yield handed(rest())
        del add, rest
        tidy()

    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


#: Of the values of a column, so many counts come to the driver at once.
BINS = 4096


def median(rows: DataFrame, value: Column) -> float | None:
    """The exact median of finite numbers, as numpy has it. None if there are none.

    Values are counted in equal bins between the least and the greatest; the bin of the middle is then counted in the same way, until it
    holds one value or the two in the middle are in different ones. So a pass brings BINS counts to the driver, however many rows there are.
    """
    values = rows.select(value.cast("double").alias("v"))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    first, second = (n - 1) // 2, n // 2  # places among the values from low to high
    while low < high:
        place = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = values.where(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        before = 0
        for b in sorted(bins, key=lambda b: b["low"]):
            if before <= first < before + b["n"]:
                middle, skipped = b, before
            if second < before + b["n"]:
                if b is not middle:
                    return (middle["high"] + b["low"]) / 2
                break
            before += b["n"]
        low, high, first, second = middle["low"], middle["high"], first - skipped, second - skipped
    return low


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
