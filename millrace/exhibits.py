"""Named queries over the given tables, one for each operator of the engine, with the same in DuckDB's SQL.

Many use a manifest made of `orders`: each order is a data file whose sizes, partition and delete files follow from its
columns, so planning is tested at the size of a large table's file list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.cli import TABLE, bench
from millrace.errors import CompactionError
from millrace.fixtures import MockTable, mock_table
from millrace.functions import sizing
from millrace.functions.transforms import PartitionField
from millrace.model import FILE_TASK, PATH, POSITION, SEQUENCE, DataFile, RewriteStats
from millrace.operators.merge_on_read import EqualityDeletes, MergeOnRead
from millrace.operators.rewrite import sort_columns
from millrace.operators.validate import written_inputs
from millrace.metrics import MemoryRegistry
from millrace.orchestrate import AutoCompaction, CommitManager, CommitParams, Compaction, merge_stats, removed_files
from millrace.plans.auto import auto_plan, plans_of, stats_frame
from millrace.plans.config import AutoCompactionConfig, BinPackConfig, CompactionConfig, ExecutionConfig, FileGroupScope, FilesWithDeletesConfig, FullCompactionConfig, GroupFilters, Grouping, Single, SmallFilesConfig
from millrace.plans.filters import DeleteFileCountFilter, SizeFilter
from millrace.plans.strategy import PlanStrategy, delete_files, group_of, strategy_of
from millrace.sources.files import balanced, by_content, with_positions
from millrace.sources.shared import new_folder
from millrace.sources.table import KNOWN_SUMMARY_KEYS, Catalog, MemoryCatalog, SortField, Table, custom_properties

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def exhibit(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new warehouse in the folder that executors share."""
    return new_folder(spark, "warehouse")


# merge-on-read

EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
SHOWN = ", ".join(EVENTS)
DAY = "day(ts)"


def events(spark: SparkSession, sf: str, positions: bool = False) -> DataFrame:
    """events as a data scan: its day of the month is the sequence number of the file that it came in."""
    df = read(spark, sf, "events")
    df = with_positions(df) if positions else df
    return df.withColumn(SEQUENCE, F.day("ts").cast("long"))


def position_rows(spark: SparkSession, sf: str, every: int) -> DataFrame:
    return with_positions(read(spark, sf, "events")).where(F.col(POSITION) % every == 0).select(PATH, POSITION)


def user_deletes(spark: SparkSession, sf: str) -> EqualityDeletes:
    """Users divisible by 10 were deleted on the 15th."""
    rows = read(spark, sf, "events").where("user_id % 10 = 0").select("user_id").distinct().withColumn(SEQUENCE, F.lit(15).cast("long"))
    return EqualityDeletes(["user_id"], rows)


def kind_deletes(spark: SparkSession, sf: str) -> EqualityDeletes:
    """(type, user) pairs with user divisible by 7 were deleted on the 20th."""
    rows = read(spark, sf, "events").where("user_id % 7 = 0").select("event_type", "user_id").distinct().withColumn(SEQUENCE, F.lit(20).cast("long"))
    return EqualityDeletes(["event_type", "user_id"], rows)


@exhibit(f"SELECT {SHOWN} FROM events")
def mor_no_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return MergeOnRead(EVENTS, read(spark, sf, "events")).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE event_id % 7 <> 0")
def mor_position_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return MergeOnRead(EVENTS, events(spark, sf, True), position_rows(spark, sf, 7), False).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE NOT (user_id % 10 = 0 AND {DAY} < 15)")
def mor_equality_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return MergeOnRead(EVENTS, events(spark, sf), equality=[user_deletes(spark, sf)]).frame()


@exhibit(f"SELECT {SHOWN} FROM events")
def mor_equality_same_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """A delete of the same sequence number deletes nothing."""
    e = read(spark, sf, "events").select("event_id", F.day("ts").cast("long").alias(SEQUENCE))
    return MergeOnRead(EVENTS, events(spark, sf), equality=[EqualityDeletes(["event_id"], e, False)]).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE NOT (user_id % 10 = 0 AND {DAY} < 15) AND NOT (user_id % 7 = 0 AND {DAY} < 20)")
def mor_equality_multi_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Deletes with different id columns, not consecutive."""
    users = user_deletes(spark, sf)
    return MergeOnRead(EVENTS, events(spark, sf), equality=[users, kind_deletes(spark, sf), users]).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE NOT {DAY} < 10")
def mor_equality_theta_only(spark: SparkSession, sf: str) -> DataFrame:
    """A delete without id columns goes by sequence alone."""
    rows = spark.range(1).select(F.lit(10).cast("long").alias(SEQUENCE))
    return MergeOnRead(EVENTS, events(spark, sf), equality=[EqualityDeletes([], rows)]).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE event_id % 5 <> 0 AND NOT (user_id % 10 = 0 AND {DAY} < 15)")
def mor_both_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return MergeOnRead(EVENTS, events(spark, sf, True), position_rows(spark, sf, 5), False, [user_deletes(spark, sf)]).frame()


def _null_keys(spark: SparkSession, sf: str, null_safe: bool) -> DataFrame:
    data = events(spark, sf).withColumn("user_id", F.expr("nullif(user_id, 10)"))
    rows = spark.createDataFrame([(None, 99), (20, 99)], f"user_id long, {SEQUENCE} long")
    return MergeOnRead(EVENTS, data, equality=[EqualityDeletes(["user_id"], rows)], null_safe=null_safe).frame().withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


_NULLED = "event_id, ts, CASE WHEN user_id = 10 THEN -1 ELSE user_id END AS user_id, event_type, value, props"


@exhibit(f"SELECT {_NULLED} FROM events WHERE user_id <> 20")
def mor_null_keys_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _null_keys(spark, sf, False)


@exhibit(f"SELECT {_NULLED} FROM events WHERE user_id NOT IN (10, 20)")
def mor_null_keys_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    return _null_keys(spark, sf, True)


@exhibit('SELECT event_id AS "select", event_type AS "from", value AS "where", user_id AS "order" FROM events WHERE NOT (user_id % 10 = 0 AND day(ts) < 15)')
def mor_keyword_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).selectExpr("event_id AS `select`", "event_type AS `from`", "value AS `where`", "user_id AS `order`", SEQUENCE)
    d = user_deletes(spark, sf)
    return MergeOnRead(["select", "from", "where", "order"], df, equality=[EqualityDeletes(["order"], d.rows.withColumnRenamed("user_id", "order"))]).frame()


@exhibit(f"SELECT {SHOWN} FROM events WHERE event_id % 5 <> 0 AND NOT (user_id % 10 = 0 AND {DAY} < 15)")
def mor_sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same query as SQL text over views."""
    q = MergeOnRead(EVENTS, events(spark, sf, True), position_rows(spark, sf, 5), False, [user_deletes(spark, sf)])
    name = f"v{uuid.uuid4().hex}"
    q.data.createOrReplaceTempView(f"{name}_data")
    q.positions.createOrReplaceTempView(f"{name}_pos")
    q.equality[0].rows.createOrReplaceTempView(f"{name}_eq_0")
    return spark.sql(q.sql(f"{name}_data", f"{name}_pos", f"{name}_eq"))


@exhibit("SELECT event_id, event_id AS pos, day(ts) AS seq FROM events")
def scan_hidden_columns(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, True).select("event_id", F.col(POSITION).alias("pos"), F.col(SEQUENCE).alias("seq"))


@exhibit("SELECT event_id, value FROM events WHERE NOT (user_id % 10 = 0 AND day(ts) < 15) AND event_type = 'click'")
def mor_predicate_and_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns and a filter: both reach the scan through the anti join."""
    return MergeOnRead(EVENTS, events(spark, sf), equality=[user_deletes(spark, sf)]).frame().where("event_type = 'click'").select("event_id", "value")


# planning over the manifest of orders

MANIFEST_SQL = """
WITH vm AS (
  SELECT o_orderkey AS k, 'f' || o_orderkey AS file_path, CAST(round(o_totalprice * 100) AS BIGINT) AS length,
         CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 7 AS file_size_in_bytes,
         coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END, '') AS scope, o_orderkey % 5 AS nd FROM orders),
dels AS (
  SELECT file_path, scope, length, 'd' || (k % 97) || '_' || i AS path, CASE WHEN i % 2 = 0 THEN 'eq' ELSE 'pos' END AS content, 1000 + i AS bytes
  FROM (SELECT *, unnest(range(1, nd + 1)) AS i FROM vm))
"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """FILE_TASK rows made of orders."""
    size = F.round(F.col("o_totalprice") * 100).cast("long")
    k = F.col("o_orderkey")
    deletes = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: (i > 0) & (i <= k % 5)),
        lambda i: F.struct(
            F.concat(F.lit("d"), (k % 97).cast("string"), F.lit("_"), i.cast("string")).alias("file_path"),
            F.when(i % 2 == 0, "eq").otherwise("pos").alias("content"),
            (F.lit(1000) + i).cast("long").alias("length"),
            (F.lit(1000) + i).cast("long").alias("file_size_in_bytes"),
            F.lit(10).cast("long").alias("record_count"),
            F.lit(9).cast("long").alias("sequence_number"),
            F.when(i % 2 == 0, F.array(F.lit(1))).alias("equality_ids"),
        ),
    )
    columns = {
        "file_path": F.concat(F.lit("f"), k.cast("string")), "content": F.lit("data"), "file_format": F.lit("parquet"), "start": F.lit(0).cast("long"), "length": size, "file_size_in_bytes": size + k % 7,
        "record_count": F.lit(100).cast("long"), "sequence_number": F.lit(1).cast("long"), "spec_id": F.lit(0), "partition_key": F.when(k % 11 != 0, F.col("o_orderstatus")),
        "equality_ids": F.lit(None).cast("array<int>"), "referenced_data_file": F.lit(None).cast("string"), "deletes": deletes,
    }
    return read(spark, sf, "orders").select(*[c.alias(n) for n, c in columns.items()]).select(*FILE_TASK.fieldNames())


FILES = ["file_path", "length"]


@exhibit("SELECT 'f' || o_orderkey AS file_path, CAST(round(o_totalprice * 100) AS BIGINT) AS length FROM orders WHERE o_orderpriority LIKE '1%'")
def scan_content_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Data files of a list in which only orders of priority 1 are data files."""
    rows = manifest(spark, sf).drop("content").join(read(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("file_path"), F.when(F.col("o_orderpriority").startswith("1"), "data").otherwise("eq").alias("content")), "file_path")
    return by_content(rows)[0].select(*FILES)


def _sizes(low: int | None, high: int | None) -> Query:
    return lambda spark, sf: SizeFilter(low, high).filter(manifest(spark, sf)).select(*FILES)


for _name, _low, _high in (("filter_size_range", 5_000_000, 20_000_000), ("filter_size_min_only", 20_000_000, None), ("filter_size_max_only", None, 5_000_000), ("filter_size_inverted", 20_000_000, 5_000_000)):
    QUERIES[_name] = _sizes(_low, _high)
    ORACLES[_name] = MANIFEST_SQL + f"SELECT file_path, length FROM vm WHERE {f'length >= {_low}' if _low else 'true'} AND {f'length < {_high}' if _high else 'true'}"


@exhibit(MANIFEST_SQL + "SELECT file_path, length FROM vm WHERE nd >= 3")
def filter_delete_count(spark: SparkSession, sf: str) -> DataFrame:
    return DeleteFileCountFilter(3).filter(manifest(spark, sf)).select(*FILES)


@exhibit(MANIFEST_SQL + "SELECT count(*) AS total_data_files, count(*) FILTER (length < 10000000) AS small_files_count, count(*) FILTER (nd >= 3) AS delete_heavy_files_count, CAST(sum(length) AS BIGINT) AS total_data_bytes FROM vm")
def snapshot_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats_frame(manifest(spark, sf), 10_000_000, 3)


TOTALS = ["group_id", "total_size", "data_file_count", "position_delete_file_count", "equality_delete_file_count", "input_files_count", "input_total_bytes"]


def _groups_sql(select: str, where: str = "true", having: str = "true", scope: str = "scope", more: str = "") -> str:
    """Totals of groups of a manifest of one bin for each scope."""
    return (
        MANIFEST_SQL
        + f""", chosen AS (SELECT * FROM vm WHERE {where}),
data AS (SELECT {scope} AS g, sum(length)::BIGINT AS total_size, count(*) AS data_file_count, sum(file_size_in_bytes)::BIGINT AS data_bytes FROM chosen GROUP BY 1),
each_ AS (SELECT DISTINCT {scope.replace("scope", "dels.scope")} AS g, content, path, bytes FROM dels JOIN chosen USING (file_path)),
del AS (SELECT g, count(*) FILTER (content = 'pos') AS position_delete_file_count, count(*) FILTER (content = 'eq') AS equality_delete_file_count, sum(bytes)::BIGINT AS del_bytes FROM each_ GROUP BY 1),
groups AS (
  SELECT g || '#0' AS group_id, total_size, data_file_count, data_bytes, coalesce(position_delete_file_count, 0) AS position_delete_file_count, coalesce(equality_delete_file_count, 0) AS equality_delete_file_count,
         data_file_count + coalesce(position_delete_file_count, 0) + coalesce(equality_delete_file_count, 0) AS input_files_count, data_bytes + coalesce(del_bytes, 0) AS input_total_bytes
  FROM data LEFT JOIN del USING (g)){more}
SELECT {select} FROM groups WHERE {having}"""
    )


ALL_TOTALS = ", ".join(TOTALS)


def _totals(strategy: PlanStrategy) -> Query:
    return lambda spark, sf: strategy.groups(strategy.assign(manifest(spark, sf))).select(*TOTALS)


def _full(grouping: Grouping = Single(), scope: FileGroupScope = FileGroupScope.PARTITION) -> FullCompactionConfig:
    return FullCompactionConfig(target_file_size_bytes=1_000_000_000, max_input_parallelism=32, max_output_parallelism=8, grouping_strategy=grouping, file_group_scope=scope)


def _small(filters: GroupFilters = GroupFilters()) -> SmallFilesConfig:
    return SmallFilesConfig(**vars(_full()), small_file_threshold_bytes=10_000_000, group_filters=filters)


QUERIES["group_single_partition"] = _totals(strategy_of(_full()))
ORACLES["group_single_partition"] = _groups_sql(ALL_TOTALS)
QUERIES["group_single_table"] = _totals(strategy_of(_full(scope=FileGroupScope.TABLE)))
ORACLES["group_single_table"] = _groups_sql(ALL_TOTALS, scope="left(scope, 0)")
QUERIES["group_filter_min_size"] = _totals(strategy_of(_small(GroupFilters(min_group_size_bytes=1_000_000_000))))
ORACLES["group_filter_min_size"] = _groups_sql(ALL_TOTALS, "length < 10000000", "total_size >= 1000000000")
QUERIES["group_filter_min_count"] = _totals(strategy_of(_small(GroupFilters(min_group_file_count=500))))
ORACLES["group_filter_min_count"] = _groups_sql(ALL_TOTALS, "length < 10000000", "data_file_count >= 500")


@exhibit(MANIFEST_SQL + "SELECT scope || '#0' AS group_id, content, path AS file_path, min(bytes) AS bytes FROM dels GROUP BY ALL")
def group_delete_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Delete files of each group, every path once."""
    placed = strategy_of(_full()).assign(manifest(spark, sf))
    return delete_files(placed).withColumnRenamed("path", "file_path")


PACK = 2_000_000_000
_BINS_SQL = (
    MANIFEST_SQL.replace("WITH vm", "WITH RECURSIVE vm")
    + f""", sorted AS (SELECT scope, file_path, file_size_in_bytes AS w, row_number() OVER (PARTITION BY scope ORDER BY file_size_in_bytes DESC, file_path) AS rn FROM vm),
packed AS (
  SELECT scope, file_path, rn, 0 AS bin, w AS fill FROM sorted WHERE rn = 1
  UNION ALL
  SELECT s.scope, s.file_path, s.rn, CASE WHEN p.fill + s.w <= {PACK} THEN p.bin ELSE p.bin + 1 END, CASE WHEN p.fill + s.w <= {PACK} THEN p.fill + s.w ELSE s.w END
  FROM packed p JOIN sorted s ON s.scope = p.scope AND s.rn = p.rn + 1)
"""
)


@exhibit(_BINS_SQL + "SELECT scope || '#' || bin AS group_id, count(*) AS files, sum(w)::BIGINT AS bytes FROM packed JOIN sorted USING (scope, file_path) GROUP BY 1")
def binpack_groups(spark: SparkSession, sf: str) -> DataFrame:
    placed = strategy_of(_full(BinPackConfig(PACK))).assign(manifest(spark, sf))
    return placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size_in_bytes").alias("bytes"))


@exhibit(
    MANIFEST_SQL.replace("WITH vm", "WITH RECURSIVE vm")
    + """, sorted AS (SELECT length, row_number() OVER (ORDER BY file_path) AS rn FROM vm),
dealt AS (
  SELECT 0::BIGINT AS rn, list_transform(range(16), lambda x: 0::BIGINT) AS bytes, list_transform(range(16), lambda x: 0::BIGINT) AS files
  UNION ALL
  SELECT s.rn, list_transform(d.bytes, lambda x, i: CASE WHEN i = list_position(d.bytes, list_min(d.bytes)) THEN x + s.length ELSE x END),
         list_transform(d.files, lambda x, i: CASE WHEN i = list_position(d.bytes, list_min(d.bytes)) THEN x + 1 ELSE x END)
  FROM dealt d JOIN sorted s ON s.rn = d.rn + 1),
last AS (SELECT bytes, files FROM dealt ORDER BY rn DESC LIMIT 1)
SELECT (generate_subscripts(bytes, 1) - 1)::INTEGER AS split, unnest(files)::BIGINT AS files, unnest(bytes)::BIGINT AS bytes FROM last"""
)
def split_balance(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(manifest(spark, sf), 16).groupBy("split").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


# sizing, over every order as one group

TARGET = 10_000_000


def _expected_sql(b: str, target: int = TARGET) -> str:
    low, most = sizing.min_file_size(target), min(target * 11 // 10, sizing.write_max_file_size(target))
    return f"CASE WHEN {b} < {target} THEN 1 WHEN {b} % {target} > {low} THEN ({b} + {target - 1}) // {target} WHEN {b} // ({b} // {target}) <= {most} THEN {b} // {target} ELSE ({b} + {target - 1}) // {target} END"


def _split_sql(b: str, target: int = TARGET) -> str:
    one = f"({b} // ({_expected_sql(b, target)}) + {sizing.SPLIT_OVERHEAD})"
    return f"CASE WHEN {one} < {target} THEN {target} ELSE least({one}, {sizing.write_max_file_size(target)}) END"


@exhibit(MANIFEST_SQL + f"SELECT file_path, CAST({_expected_sql('length')} AS BIGINT) AS files FROM vm")
def expected_output_files(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("file_path", sizing.expected_output_files_col(F.col("length"), TARGET).alias("files"))


@exhibit(MANIFEST_SQL + f"SELECT file_path, CAST({_split_sql('length')} AS BIGINT) AS split FROM vm")
def input_split_size(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("file_path", sizing.input_split_size_col(F.col("length"), TARGET).alias("split"))


@exhibit(MANIFEST_SQL + f"SELECT file_path, CAST(CASE WHEN nd > 1 AND length > 0 AND length < {TARGET} THEN 1 ELSE nd END AS BIGINT) AS writers FROM vm")
def output_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("file_path", sizing.output_parallelism_heuristic_col(F.size("deletes").cast("long"), F.col("length"), TARGET).alias("writers"))


_T = 1_000_000_000
_PARALLEL_SQL = (
    f"group_id, CAST(least(greatest((input_total_bytes + ({_split_sql('input_total_bytes', _T)}) - 1) // ({_split_sql('input_total_bytes', _T)}), (input_files_count + 31) // 32), 32) AS BIGINT) AS executor_parallelism, "
    f"CAST(CASE WHEN greatest(1, least({_expected_sql('input_total_bytes', _T)}, 8)) > 1 AND data_bytes > 0 AND data_bytes < {_T} THEN 1 ELSE greatest(1, least({_expected_sql('input_total_bytes', _T)}, 8)) END AS BIGINT) AS output_parallelism"
)


def _planned(config) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        strategy = strategy_of(config)
        return strategy.groups(strategy.assign(manifest(spark, sf))).select(*TOTALS, "executor_parallelism", "output_parallelism")

    return run


@exhibit(_groups_sql(_PARALLEL_SQL))
def parallelism(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(_full())(spark, sf).select("group_id", "executor_parallelism", "output_parallelism")


_deletes_config = FilesWithDeletesConfig(**vars(_full()), min_delete_file_count_threshold=3)
for _name, _config, _where in (("plan_small_files", _small(), "length < 10000000"), ("plan_full", _full(), "true"), ("plan_files_with_deletes", _deletes_config, "nd >= 3")):
    QUERIES[_name] = _planned(_config)
    ORACLES[_name] = _groups_sql(f"{ALL_TOTALS}, {_PARALLEL_SQL.removeprefix('group_id, ')}", _where)


# the automatic planner

_AUTO = AutoCompactionConfig(target_file_size_bytes=1_000_000_000, max_input_parallelism=32, max_output_parallelism=8, small_file_threshold_bytes=10_000_000, min_delete_file_count_threshold=3)


def _report(spark: SparkSession, sf: str, budget: int | None) -> DataFrame:
    """The automatic planner's report as one row."""
    r = auto_plan(manifest(spark, sf), replace(_AUTO, max_auto_plans_per_run=budget))
    return spark.createDataFrame([(len(r.plans), r.planned_input_bytes, r.planned_input_files, r.rewrite_ratio)], "plans long, planned_input_bytes long, planned_input_files long, rewrite_ratio double")


def _report_sql(budget: str) -> str:
    return (
        _groups_sql("1", "nd >= 3").rpartition("SELECT 1")[0]
        + f", kept AS (SELECT * FROM groups ORDER BY total_size DESC, group_id {budget}) SELECT count(*) AS plans, sum(input_total_bytes)::BIGINT AS planned_input_bytes, sum(input_files_count)::BIGINT AS planned_input_files, "
        "sum(total_size)::DOUBLE / (SELECT sum(length) FROM vm)::DOUBLE AS rewrite_ratio FROM kept"
    )


@exhibit(_report_sql(""))
def auto_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, None)


@exhibit(_report_sql("LIMIT 2"))
def auto_report_capped(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, 2)


@exhibit(
    MANIFEST_SQL
    + "SELECT CASE WHEN count(*) FILTER (nd >= 3) >= 1 THEN 'FilesWithDeletes' WHEN count(*) FILTER (length < 10000000) >= 5 THEN 'SmallFiles' END AS strategy, 'Recommended' AS reason FROM vm"
)
def auto_candidates(spark: SparkSession, sf: str) -> DataFrame:
    report = auto_plan(manifest(spark, sf), _AUTO)
    return spark.createDataFrame([(report.selected_strategy.value, report.reason.value)], "strategy string, reason string")


@exhibit(_groups_sql("group_id, input_files_count AS files, data_file_count AS rows_of_plan, total_size AS bytes_of_plan", "length < 10000000"))
def plans_and_their_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each plan with the number of its files, and what its own rows are: plans without files are not there."""
    plans = plans_of(*strategy_of(_small()).execute(manifest(spark, sf)), "main", 1)
    rows = []
    for p in plans:
        own = p.files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).first()
        rows.append((p.group.group_id, p.file_count(), own["n"], own["b"]))
    return spark.createDataFrame(rows, "group_id string, files long, rows_of_plan long, bytes_of_plan long")


@exhibit(
    "SELECT * FROM (VALUES ('full', 'NoFileFilters -> SingleGrouping -> NoGroupFilters'), ('table', 'NoFileFilters -> Table -> SingleGrouping -> NoGroupFilters'), "
    "('packed', 'NoFileFilters -> BinPackGrouping[target=1907MB] -> NoGroupFilters')) AS t(name, description)"
)
def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    configs = {"full": _full(), "table": _full(scope=FileGroupScope.TABLE), "packed": _full(BinPackConfig(PACK))}
    return spark.createDataFrame([(n, str(strategy_of(c))) for n, c in configs.items()], "name string, description string")


# statistics, lookups, properties


@exhibit(_groups_sql("CAST(sum(input_files_count) AS BIGINT) AS input_files_count, CAST(sum(input_total_bytes) AS BIGINT) AS input_total_bytes, CAST(sum(data_file_count) AS BIGINT) AS input_data_file_count, CAST(2 * count(*) AS BIGINT) AS output_files_count, CAST(2000 * count(*) AS BIGINT) AS output_total_bytes"))
def merge_stats_of_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Each plan's stats, with two output files of 1000 bytes, merged."""
    groups = [group_of(r) for r in strategy_of(_full()).execute(manifest(spark, sf))[1].collect()]
    stats = merge_stats([RewriteStats.of(g, [DataFile("a", 1000, 1), DataFile("b", 1000, 1)]) for g in groups])
    return stats.as_row(spark).select("input_files_count", "input_total_bytes", "input_data_file_count", "output_files_count", "output_total_bytes")


@exhibit(_groups_sql("data_file_count AS input_data_file_count, position_delete_file_count AS input_position_delete_file_count, equality_delete_file_count AS input_equality_delete_file_count, input_total_bytes", scope="left(scope, 0)"))
def rewrite_stats(spark: SparkSession, sf: str) -> DataFrame:
    groups = strategy_of(_full(scope=FileGroupScope.TABLE)).execute(manifest(spark, sf))[1]
    stats = RewriteStats.of(group_of(groups.first()), [])
    return stats.as_row(spark).select("input_data_file_count", "input_position_delete_file_count", "input_equality_delete_file_count", "input_total_bytes")


@exhibit(MANIFEST_SQL + "SELECT file_path, length FROM vm WHERE k % 3 = 0")
def semi_join_output_files(spark: SparkSession, sf: str) -> DataFrame:
    paths = read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("f"), "o_orderkey").alias("file_path"))
    return written_inputs(manifest(spark, sf), paths).select(*FILES)


@exhibit(MANIFEST_SQL + "SELECT file_path, length FROM vm WHERE k % 4 = 1")
def rewritten_file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    paths = read(spark, sf, "orders").where("o_orderkey % 4 = 1").select(F.concat(F.lit("f"), "o_orderkey").alias("file_path"))
    return removed_files(manifest(spark, sf), paths).select(*FILES)


@exhibit("SELECT o_orderkey, 'owner' AS name FROM orders")
def summary_property_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Of a summary with a known key, a partition's and a user's, the user's stays."""
    left = custom_properties({KNOWN_SUMMARY_KEYS[0]: "1", "partitions.a=1": "x", "operation": "append", "owner": "me"})
    return read(spark, sf, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, left))).alias("name"))


@exhibit("SELECT (SELECT count(*) FROM events WHERE event_id % 7 <> 0) AS input_rows, (SELECT count(*) FROM events WHERE event_id % 7 <> 0) AS output_rows")
def validate_counts(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.validate import digest

    before, after = mor_position_deletes(spark, sf), read(spark, sf, "events").where("event_id % 7 <> 0")
    both = digest(before, "input").union(digest(after, "output"))
    return both.agg(F.max(F.when(F.col("side") == "input", F.col("rows"))).alias("input_rows"), F.max(F.when(F.col("side") == "output", F.col("rows"))).alias("output_rows"))


# tables from end to end, in a scratch warehouse


def _customers(spark: SparkSession, sf: str, **options) -> tuple[Catalog, DataFrame]:
    """A table of customer, appended in three parts; then users divisible by 10 deleted by key, and the first rows of one file by position."""
    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "customer")
    table = catalog.create_table("t", df.schema, **options)
    for i in range(3):
        table = table.append(df.where(F.col("c_custkey") % 3 == i))
    table = table.delete_equal(df.where("c_custkey % 10 = 0").select("c_custkey"), ["c_custkey"])
    rows = with_positions(spark.read.schema(df.schema).parquet(*[r[0] for r in table.entries(table.metadata.refs["main"]).where("content = 'data'").select("file_path").collect()]))
    victims = rows.where("c_custkey % 60 = 7").select(F.col(PATH).alias("file_path"), F.col(POSITION).alias("pos"))
    table.delete_positions(victims)
    return catalog, df


_LEFT = "c_custkey % 10 <> 0 AND c_custkey % 60 <> 7"


@exhibit(f"SELECT * FROM customer WHERE {_LEFT}")
def e2e_compact_preserves_rows(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = _customers(spark, sf)
    Compaction(catalog, "t", CompactionConfig(execution=ExecutionConfig(enable_validate_compaction=True))).compact()
    return catalog.load_table("t").read()


@exhibit(f"SELECT * FROM customer WHERE {_LEFT}")
def e2e_read_before_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf)[0].load_table("t").read()


@exhibit(f"SELECT * FROM customer WHERE {_LEFT}")
def e2e_partitioned_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of the key, each sorted by balance."""
    catalog, _ = _customers(spark, sf, partition_fields=[PartitionField("c_custkey", "bucket[5]")], sort_fields=[SortField("c_acctbal", False, False)])
    Compaction(catalog, "t", CompactionConfig()).compact()
    return catalog.load_table("t").read()


def _files(table: Table, branch: str = "main") -> int:
    return by_content(table.entries(table.metadata.refs[branch]))[0].count()


@exhibit(f"SELECT 3::BIGINT AS main_files, 1::BIGINT AS branch_files, count(*) AS branch_rows FROM customer WHERE {_LEFT}")
def e2e_steps_on_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Plan, rewrite and commit one by one, on a branch; main keeps its files."""
    catalog, _ = _customers(spark, sf)
    catalog.load_table("t").create_branch("dev")
    c = Compaction(catalog, "t", CompactionConfig(), to_branch="dev")
    results = [c.rewrite_plan(p, ExecutionConfig(enable_validate_compaction=True), c.load_table()) for p in c.plan_compaction()]
    table = c.commit_rewrite_results(results)
    return spark.createDataFrame([(_files(table), _files(table, "dev"), table.read("dev").count())], "main_files long, branch_files long, branch_rows long")


@exhibit(f"SELECT * FROM customer WHERE {_LEFT} AND c_custkey % 7 <> 3")
def e2e_commit_after_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are deleted between the rewrite and its commit stay deleted."""
    catalog, df = _customers(spark, sf)
    c = Compaction(catalog, "t", CompactionConfig())
    results = [c.rewrite_plan(p, ExecutionConfig(), c.load_table()) for p in c.plan_compaction()]
    catalog.load_table("t").delete_equal(df.where("c_custkey % 7 = 3").select("c_custkey"), ["c_custkey"])
    return c.commit_rewrite_results(results).read()


@exhibit("SELECT 8::BIGINT AS files, count(*) AS rows_, sum(c_acctbal::DECIMAL(20, 2))::DOUBLE AS balance FROM customer")
def e2e_parallel_partition(spark: SparkSession, sf: str) -> DataFrame:
    """One partition, rewritten by eight tasks into eight files."""
    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "customer").withColumn("part", F.lit("one"))
    table = catalog.create_table("t", df.schema, partition_fields=[PartitionField("part")]).append(df)
    most = sum(r[0] for r in table.entries(table.metadata.refs["main"]).select("file_size_in_bytes").collect()) // 10
    plan = FullCompactionConfig(target_file_size_bytes=most, max_output_parallelism=8, enable_heuristic_output_parallelism=False)
    out = Compaction(catalog, "t", CompactionConfig(plan, ExecutionConfig(enable_validate_compaction=True))).compact()
    return out.table.read().agg(F.lit(len(out.output_files)).cast("long").alias("files"), F.count(F.lit(1)).alias("rows_"), F.sum(F.col("c_acctbal").cast("decimal(20,2)")).cast("double").alias("balance"))


@exhibit("SELECT * FROM customer")
def e2e_memory_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog, df = MemoryCatalog(spark), read(spark, sf, "customer")
    catalog.create_table("t", df.schema)
    catalog.load_table("t").append(df)
    return catalog.load_table("t").read()


@exhibit("SELECT c_nationkey, count(*) AS rows_, 1::BIGINT AS files FROM customer GROUP BY ALL")
def e2e_many_plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan for each partition, some at a time, in one commit: afterwards each partition has one file with all its rows."""
    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "customer")
    table = catalog.create_table("t", df.schema, partition_fields=[PartitionField("c_nationkey")])
    for i in range(2):
        table = table.append(df.where(F.col("c_custkey") % 2 == i))
    table = Compaction(catalog, "t", CompactionConfig(execution=ExecutionConfig(max_concurrent_compaction_plans=8))).compact().table
    key = F.regexp_extract("partition_key", "=(.*)", 1).cast(df.schema["c_nationkey"].dataType).alias("c_nationkey")
    return table.entries(table.metadata.refs["main"]).groupBy(key).agg(F.sum("record_count").alias("rows_"), F.count(F.lit(1)).alias("files"))


@exhibit("SELECT count(*) AS rows_, true AS bounded, true AS several FROM lineitem")
def e2e_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """One writer rolls to a new file at the target size, whatever the size of the files that it rewrites."""
    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "lineitem")
    table = catalog.create_table("t", df.schema)
    for i in range(2):
        table = table.append(df.where(F.col("l_orderkey") % 2 == i).coalesce(1))
    size = sum(r[0] for r in table.entries(table.metadata.refs["main"]).select("file_size_in_bytes").collect())
    out = Compaction(catalog, "t", CompactionConfig(FullCompactionConfig(max_output_parallelism=1), ExecutionConfig(target_file_size_bytes=size // 3 + 1))).compact()
    most, several = max(f.file_size_in_bytes for f in out.output_files) <= size // 3 * 1.5, 3 <= len(out.output_files) <= 4
    return out.table.read().agg(F.count(F.lit(1)).alias("rows_"), F.lit(most).alias("bounded"), F.lit(several).alias("several"))


@exhibit(
    "SELECT * FROM (VALUES ('branch', 'Execution failed: Compaction plan branch ' || chr(39) || 'x' || chr(39) || ' does not match configured branch ' || chr(39) || 'main' || chr(39)), ('config', 'Execution failed: CompactionConfig is required'), "
    "('gone', 'Table error: 3 of 3 rewritten files are no longer in the table'), ('none', 'Execution failed: No rewrite results to commit'), ('slept', '[1.0, 2.0]'), ('snapshot', 'Execution failed: Snapshot 5 not found')) AS t(step, message)"
)
def e2e_errors_of_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What each step refuses, and how long a commit that comes second waits before it tries again."""
    catalog, _ = _customers(spark, sf)
    c, bare = Compaction(catalog, "t", CompactionConfig()), Compaction(catalog, "t")
    table = c.load_table()
    plan = c.plan_compaction()[0]
    results, found = [c.rewrite_plan(plan, ExecutionConfig(), table)], []
    stale, slept = [table, table, None], []
    catalog.load_table("t").create_branch("other")  # so the loaded version is not the newest
    head = table.metadata.snapshot_for("main")
    CommitManager(lambda: stale.pop(0) or catalog.load_table("t"), CommitParams(head.snapshot_id, head.schema_id), sleep=slept.append).rewrite_files_from_results(results, "main")
    refused = {
        "config": bare.compact, "branch": lambda: c.rewrite_plan(replace(plan, to_branch="x"), ExecutionConfig(), table), "snapshot": lambda: c.rewrite_plan(replace(plan, snapshot_id=5), ExecutionConfig(), table),
        "none": lambda: c.commit_rewrite_results([]), "gone": lambda: c.commit_rewrite_results(results),
    }
    for step, run in refused.items():
        try:
            run()
        except CompactionError as e:
            found.append((step, str(e)))
    return spark.createDataFrame([*found, ("slept", str(slept))], "step string, message string")


@exhibit("SELECT 2::BIGINT AS data_files, 1::BIGINT AS output_files, 1960::BIGINT AS rows_")
def mock_table_bench(spark: SparkSession, sf: str) -> DataFrame:
    """The made-up table of the command line, compacted: two files, a file of position deletes for each."""
    catalog, spec = Catalog(spark, scratch(spark)), MockTable(files=2, rows_per_file=1000, equality_deletes_per_file=0, position_deletes_per_file=20)
    table = mock_table(catalog, TABLE, spec)
    deletes = by_content(table.entries(table.metadata.refs["main"]))[1].count()
    out = bench(catalog)
    rows = catalog.load_table(TABLE).read().count()
    return spark.createDataFrame([(out["input_files"] - deletes, out["output_files"], rows)], "data_files long, output_files long, rows_ long")


@exhibit(
    "SELECT * FROM (VALUES ('compaction_commit_counter', 1.0::DOUBLE), ('compaction_input_files_count', 5.0), ('compaction_output_files_count', 1.0), ('compaction_engine_batch_row_count_dist', 1.0), ('compaction_engine_batch_bytes_dist', 1.0), "
    "('compaction_engine_batch_write_duration', 1.0), ('compaction_plan_file_count', 1.0)) AS t(name, value) UNION ALL "
    f"SELECT 'compaction_engine_records_processed_total', count(*)::DOUBLE FROM customer WHERE {_LEFT}"
)
def compaction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Some counters, and how often some histograms were observed, of one compaction."""
    registry, labels = MemoryRegistry(), ("default", "t")
    Compaction(_customers(spark, sf)[0], "t", CompactionConfig(), registry=registry).compact()
    counted = ["compaction_commit_counter", "compaction_input_files_count", "compaction_output_files_count", "compaction_engine_records_processed_total"]
    observed = ["compaction_engine_batch_row_count_dist", "compaction_engine_batch_bytes_dist", "compaction_engine_batch_write_duration", "compaction_plan_file_count"]
    rows = [(n, float(registry.counters[n, labels])) for n in counted] + [(n, float(sum(registry.histograms[n, labels]))) for n in observed]
    return spark.createDataFrame(rows, "name string, value double")


@exhibit("SELECT * FROM customer")
def stream_batch_again(spark: SparkSession, sf: str) -> DataFrame:
    """A micro-batch that comes again after another writer's commit is not appended twice."""
    from millrace.streaming.trigger import CompactingSink

    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "customer")
    catalog.create_table("t", df.schema)
    sink = CompactingSink(catalog, "t", every=0)
    sink(df.where("c_custkey % 2 = 0"), 0)
    catalog.load_table("t").append(df.where("c_custkey % 2 = 1"))
    sink(df.where("c_custkey % 2 = 0"), 0)
    return catalog.load_table("t").read()


@exhibit("SELECT c_name, c_custkey FROM customer WHERE c_custkey % 10 <> 0")
def schema_change_keeps_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Columns move and go; deletes by key still hit the key."""
    catalog, df = Catalog(spark, scratch(spark)), read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    table = catalog.create_table("t", df.schema).append(df)
    table = table.delete_equal(df.where("c_custkey % 10 = 0").select("c_custkey"), ["c_custkey"])
    return table.evolve(df.select("c_name", "c_custkey").schema).read()


@exhibit("SELECT true AS first_ran, false AS second_ran, 1::BIGINT AS data_files, 0::BIGINT AS delete_files")
def e2e_second_run_noop(spark: SparkSession, sf: str) -> DataFrame:
    """The automatic planner has nothing left after one run."""
    catalog, _ = _customers(spark, sf)
    config = AutoCompactionConfig(min_delete_file_count_threshold=1)
    first, second = (AutoCompaction(catalog, "t", config).compact() for _ in range(2))
    table = catalog.load_table("t")
    data, deletes = by_content(table.entries(table.metadata.refs["main"]))
    return spark.createDataFrame([(first is not None, second is not None, data.count(), deletes.count())], "first_ran boolean, second_ran boolean, data_files long, delete_files long")


@exhibit("SELECT l_orderkey, l_linenumber, l_shipdate, CAST(row_number() OVER (ORDER BY l_orderkey DESC, l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS pos FROM lineitem")
def sorted_within_file(spark: SparkSession, sf: str) -> DataFrame:
    """One file, sorted by the table's order, read back with its row positions."""
    df = read(spark, sf, "lineitem")
    order = sort_columns(df.schema, [SortField("l_orderkey", False), SortField("l_shipdate"), SortField("l_linenumber"), SortField("l_partkey"), SortField("l_suppkey"), SortField("gone")])
    where = f"{scratch(spark)}/sorted"
    df.coalesce(1).sortWithinPartitions(*order).write.parquet(where)
    return with_positions(spark.read.schema(df.schema).parquet(where)).select("l_orderkey", "l_linenumber", "l_shipdate", F.col(POSITION).alias("pos"))


_M = 4294967295
_turn = lambda x, by: f"((({x}) << {by}) | (({x}) >> {32 - by})) & {_M}"
_word = lambda x: f"(({_turn(f'(({x}) * 3432918353) & {_M}', 15)}) * 461845907) & {_M}"
_BUCKET_SQL = f"""
WITH a AS (SELECT *, {_word("o_custkey::UBIGINT")} AS k FROM orders), b AS (SELECT *, (({_turn("k", 13)}) * 5 + 3864292196) & {_M} AS h1 FROM a),
c AS (SELECT *, xor((({_turn("h1", 13)}) * 5 + 3864292196) & {_M}, 8::UBIGINT) AS h2 FROM b), d AS (SELECT *, (xor(h2, h2 >> 16) * 2246822507::UBIGINT) & {_M} AS h3 FROM c),
e AS (SELECT *, (xor(h3, h3 >> 13) * 3266489909::UBIGINT) & {_M} AS h4 FROM d), f AS (SELECT *, xor(h4, h4 >> 16) AS h FROM e)
"""


@exhibit(_BUCKET_SQL + "SELECT o_orderkey, year(o_orderdate) - 1970 AS y, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS m, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, o_custkey - o_custkey % 10 AS t, ((h & 2147483647) % 5)::BIGINT AS b FROM f")
def partition_transforms(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    of = lambda source, t: PartitionField(source, t).column(F.col(source), kinds[source])
    time = {n: of("o_orderdate", t).cast("long") for n, t in (("y", "year"), ("m", "month"), ("d", "day"))}
    return df.select("o_orderkey", *[c.alias(n) for n, c in time.items()], of("o_custkey", "truncate[10]").alias("t"), of("o_custkey", "bucket[5]").cast("long").alias("b"))
