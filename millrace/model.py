"""What the engine passes around: file tasks as a DataFrame schema, groups, plans, results."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DATA, POSITION_DELETES, EQUALITY_DELETES = "data", "pos", "eq"


def struct(spec: str) -> T.StructType:
    """A StructType of `name type, ...` with simple types; needs no session."""
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "array<int>": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.strip().split(" ") for f in spec.split(","))])


DELETE_FILE = struct("file_path string, content string, length bigint, file_size_in_bytes bigint, record_count bigint, sequence_number bigint, equality_ids array<int>")

#: One row of the planner: a file of a snapshot with the delete files that apply to it. `length` is what is read of
#: the file, `file_size_in_bytes` all of it; filters go by the first, packing and splits by the second.
FILE_TASK = T.StructType(
    [
        *struct(
            "file_path string, content string, file_format string, start bigint, length bigint, file_size_in_bytes bigint, record_count bigint, "
            "sequence_number bigint, spec_id int, partition_key string, equality_ids array<int>, referenced_data_file string"
        ).fields,
        T.StructField("deletes", T.ArrayType(DELETE_FILE)),
    ]
)

#: Hidden columns of a merge-on-read query.
SEQUENCE, PATH, POSITION = "sys_hidden_seq_num", "sys_hidden_file_path", "sys_hidden_pos"


def file_tasks(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """A planning DataFrame of dictionaries; what is left out gets a plain default."""
    default = {"content": DATA, "file_format": "parquet", "start": 0, "record_count": 0, "sequence_number": 1, "spec_id": 0, "partition_key": "", "equality_ids": None, "referenced_data_file": None, "deletes": []}
    full = []
    for r in rows:
        r = default | r
        r.setdefault("file_size_in_bytes", r.get("length", 0))
        r.setdefault("length", r["file_size_in_bytes"])
        r["deletes"] = [{f.name: d.get(f.name) for f in DELETE_FILE} | {"file_size_in_bytes": d.get("file_size_in_bytes", d.get("length", 0))} for d in r["deletes"]]
        full.append(tuple(r[f.name] if f.name != "deletes" else [tuple(d[g.name] for g in DELETE_FILE) for d in r["deletes"]] for f in FILE_TASK))
    return spark.createDataFrame(full, FILE_TASK)


@dataclass(frozen=True)
class FileGroup:
    """Totals of one group; the files themselves are in the planning DataFrame under its id."""

    group_id: str
    partition_key: str
    total_size: int = 0
    data_file_count: int = 0
    position_delete_file_count: int = 0
    equality_delete_file_count: int = 0
    data_bytes: int = 0
    position_delete_bytes: int = 0
    equality_delete_bytes: int = 0
    executor_parallelism: int = 1
    output_parallelism: int = 1

    @property
    def input_files_count(self) -> int:
        return self.data_file_count + self.position_delete_file_count + self.equality_delete_file_count

    @property
    def input_total_bytes(self) -> int:
        return self.data_bytes + self.position_delete_bytes + self.equality_delete_bytes

    def is_empty(self) -> bool:
        return self.data_file_count == 0


@dataclass(frozen=True)
class CompactionPlan:
    """A group of one snapshot of one branch. `files` has the group's rows (FILE_TASK)."""

    group: FileGroup
    to_branch: str
    snapshot_id: int
    files: DataFrame | None = field(default=None, compare=False, repr=False)

    @classmethod
    def dummy(cls) -> CompactionPlan:
        return cls(FileGroup("", ""), "main", 0)

    def has_files(self) -> bool:
        return self.group.data_file_count > 0

    def file_count(self) -> int:
        return self.group.input_files_count

    def total_bytes(self) -> int:
        return self.group.input_total_bytes


@dataclass(frozen=True)
class DataFile:
    """A file that a rewrite wrote."""

    file_path: str
    file_size_in_bytes: int
    record_count: int
    partition_key: str = ""
    sort_order_id: int = 0


@dataclass(frozen=True)
class RewriteStats:
    input_files_count: int = 0
    output_files_count: int = 0
    input_total_bytes: int = 0
    output_total_bytes: int = 0
    input_data_file_count: int = 0
    input_position_delete_file_count: int = 0
    input_equality_delete_file_count: int = 0
    input_data_file_total_bytes: int = 0
    input_position_delete_file_total_bytes: int = 0
    input_equality_delete_file_total_bytes: int = 0

    @classmethod
    def of(cls, group: FileGroup, output: list[DataFile]) -> RewriteStats:
        return cls(
            group.input_files_count, len(output), group.input_total_bytes, sum(f.file_size_in_bytes for f in output), group.data_file_count, group.position_delete_file_count,
            group.equality_delete_file_count, group.data_bytes, group.position_delete_bytes, group.equality_delete_bytes,
        )

    def __add__(self, other: RewriteStats) -> RewriteStats:
        return RewriteStats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    def as_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], ", ".join(f"{f.name} bigint" for f in fields(self)))


@dataclass(frozen=True)
class RewriteResult:
    output_files: list[DataFile]
    stats: RewriteStats
    plan: CompactionPlan
    input_rows: int | None = None  # after deletes; known if validation was asked for
    output_rows: int | None = None


@dataclass(frozen=True)
class CompactionResult:
    output_files: list[DataFile]
    stats: RewriteStats
    table: Any
    results: list[RewriteResult] = field(default_factory=list, repr=False)
