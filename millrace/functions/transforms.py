"""Partition transforms: identity, year, month, day, hour, truncate[w], bucket[n]."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError

_BUCKET = re.compile(r"(bucket|truncate)\[(\d+)\]")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur3, x86, 32 bits, as a signed integer, of one byte string."""
    mask, h = 0xFFFFFFFF, seed

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if rest := data[whole:]:
        h ^= scramble(int.from_bytes(rest, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def zero_seed(seed: int = 42) -> int:
    """The integer whose Murmur3 hash with this seed is 0. Spark's hash() starts with seed 42 and takes each value's hash as the
    next one's seed, so hash(zero_seed(), x) is Murmur3 of x with seed 0."""
    word, turned = 1 << 32, lambda x, by: x >> by | x << 32 - by & 0xFFFFFFFF
    k = turned((4 - 0xE6546B64) * pow(5, -1, word) % word, 13) ^ seed  # 4, the length in bytes, undoes what the end adds
    v = turned(k * pow(0x1B873593, -1, word) % word, 15) * pow(0xCC9E2D51, -1, word) % word
    return v - word if v >> 31 else v


def bucket(value: Column, kind: T.DataType, n: int) -> Column:
    """(hash & max int) mod n; null stays null. Integers and dates hash as longs, strings as UTF-8."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)):
        long = F.unix_date(value).cast("long") if isinstance(kind, T.DateType) else value.cast("long")
        return F.when(value.isNotNull(), F.pmod(F.hash(F.lit(zero_seed()), long).bitwiseAND(0x7FFFFFFF), F.lit(n)))
    if isinstance(kind, (T.StringType, T.BinaryType)):

        @F.pandas_udf("int")
        def of_bytes(x: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else (murmur3_32(v.encode() if isinstance(v, str) else bytes(v)) & 0x7FFFFFFF) % n for v in x], dtype="Int32")

        return of_bytes(value)
    raise ConfigError(f"bucket does not take {kind.simpleString()}")


@dataclass(frozen=True)
class PartitionField:
    """A partition column `name`: a transform of a source column."""

    source: str
    transform: str = "identity"

    @property
    def name(self) -> str:
        kind = self.transform.partition("[")[0]
        return self.source if kind == "identity" else f"{self.source}_{kind}"

    def column(self, value: Column, kind: T.DataType) -> Column:
        t = self.transform
        if t == "identity":
            return value
        if t in ("year", "month", "day", "hour"):
            return {"year": F.year(value) - 1970, "month": (F.year(value) - 1970) * 12 + F.month(value) - 1, "day": F.datediff(value, F.lit("1970-01-01").cast("date")), "hour": F.floor(F.unix_timestamp(value.cast("timestamp")) / 3600)}[t].cast("int")
        if m := _BUCKET.fullmatch(t):
            n = int(m[2])
            if n < 1:
                raise ConfigError(f"{t} needs a positive number")
            if m[1] == "bucket":
                return bucket(value, kind, n)
            if isinstance(kind, (T.StringType,)):
                return F.substring(value, 1, n)
            if isinstance(kind, T.BinaryType):
                return F.substring(value, 1, n)
            return value - F.pmod(value, F.lit(n).cast(kind))
        raise ConfigError(f"unknown partition transform {t}")


def partition_key(fields: list[PartitionField], columns: dict[str, Column]) -> Column:
    """name=value/... as one string; empty without fields."""
    if not fields:
        return F.lit("")
    return F.concat_ws("/", *[F.concat(F.lit(f"{f.name}="), F.coalesce(columns[f.name].cast("string"), F.lit("null"))) for f in fields])
