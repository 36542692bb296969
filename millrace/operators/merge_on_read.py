"""Merge-on-read: data rows without those that position or equality deletes remove.

Everything is left anti joins on the DataFrame API:

- position deletes: (path, position) of the data row is in the delete set;
- equality deletes: all id columns are equal and the data row's sequence number is *less* than the delete's.
  Deletes with one set of ids are one join, in whatever order they come; deletes without ids go by sequence alone.

A join is added only if there are deletes of its kind, and hidden columns only where a join needs them. Delete sides
are broadcast if their files have few bytes, else Catalyst joins by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.model import PATH, POSITION, SEQUENCE


def quoted(name: str, mark: str = "`") -> str:
    """An identifier in SQL text; a mark inside is doubled."""
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, keywords and dots included."""
    return df[quoted(name)]


@dataclass(frozen=True)
class EqualityDeletes:
    """Rows of delete files with one set of id columns; `rows` has these and the sequence number."""

    columns: Sequence[str]
    rows: DataFrame
    small: bool = True


@dataclass(frozen=True)
class MergeOnRead:
    """A merge-on-read query. data has the user's columns and the hidden ones that the deletes need."""

    columns: Sequence[str]
    data: DataFrame
    positions: DataFrame | None = None  # PATH, POSITION
    positions_small: bool = True
    equality: Sequence[EqualityDeletes] = field(default_factory=tuple)
    null_safe: bool = False
    scope: str | None = None  # a column of data and equality rows: deletes with a value here only hit rows with the same

    def frame(self) -> DataFrame:
        df = self.data
        if self.positions is not None:
            df = _anti(df, self.positions, self.positions_small, lambda d, x: [column(d, c) == column(x, c) for c in (PATH, POSITION)])
        for e in grouped(self.equality):
            df = _anti(df, e.rows, e.small, lambda d, x, e=e: self._equality(d, x, e))
        return df.select(*[column(df, c) for c in self.columns])

    def _equality(self, data: DataFrame, deletes: DataFrame, e: EqualityDeletes) -> list[Column]:
        out = []
        for c in e.columns:
            a, b = column(data, c), column(deletes, c)
            out.append(a.eqNullSafe(b) if self.null_safe else a == b)
        if self.scope is not None and self.scope in deletes.columns:
            out.append(deletes[self.scope].isNull() | (data[self.scope] == deletes[self.scope]))
        return [*out, data[SEQUENCE] < deletes[SEQUENCE]]

    def sql(self, data: str = "data", positions: str = "position_deletes", equality: str = "equality_deletes") -> str:
        """The same query as SQL text over views of these names (equality views are numbered from 0)."""
        return merge_sql(self.columns, data, positions if self.positions is not None else None, [(f"{equality}_{i}", list(e.columns)) for i, e in enumerate(grouped(self.equality))], self.null_safe)


def merge_sql(columns: Sequence[str], data: str, positions: str | None, equality: Sequence[tuple[str, list[str]]], null_safe: bool = False) -> str:
    """Merge-on-read as nested left anti joins in SQL text, with hidden columns only where they are needed."""
    hidden = [c for c, needed in ((SEQUENCE, bool(equality)), (PATH, positions), (POSITION, positions)) if needed]
    shown = ", ".join(quoted(c) for c in columns)
    inner = ", ".join(quoted(c) for c in [*columns, *hidden])
    query = f"SELECT {inner} FROM {quoted(data)}"
    if positions is not None:
        on = " AND ".join(f"d.{quoted(c)} = x.{quoted(c)}" for c in (PATH, POSITION))
        query = f"SELECT {inner} FROM ({query}) AS d LEFT ANTI JOIN {quoted(positions)} AS x ON {on}"
    for view, ids in equality:
        equal = [f"d.{quoted(c)} {'<=>' if null_safe else '='} x.{quoted(c)}" for c in ids]
        on = " AND ".join([*equal, f"d.{quoted(SEQUENCE)} < x.{quoted(SEQUENCE)}"])
        query = f"SELECT {inner} FROM ({query}) AS d LEFT ANTI JOIN {quoted(view)} AS x ON {on}"
    return f"SELECT {shown} FROM ({query}) AS final_result" if hidden else query


def _anti(data: DataFrame, deletes: DataFrame, small: bool, condition) -> DataFrame:
    right = F.broadcast(deletes) if small else deletes
    return data.join(right, reduce(and_, condition(data, deletes)), "left_anti")


def grouped(deletes: Sequence[EqualityDeletes]) -> list[EqualityDeletes]:
    """One entry for each set of id columns: anti joins commute, so deletes need not be consecutive."""
    out: dict[tuple[str, ...], EqualityDeletes] = {}
    for e in deletes:
        key = tuple(sorted(e.columns))
        if key in out:
            out[key] = EqualityDeletes(out[key].columns, out[key].rows.unionByName(e.rows), out[key].small and e.small)
        else:
            out[key] = e
    return list(out.values())


def equality_columns(schema_ids: dict[int, str], equality_ids: Sequence[int]) -> list[str]:
    """Names of the ids in the current schema; an id that isn't a top-level field of it is an error."""
    missing = [i for i in equality_ids if i not in schema_ids]
    if missing:
        raise ConfigError(f"equality ids {missing} are not top-level fields of the current schema")
    return [schema_ids[i] for i in equality_ids]
