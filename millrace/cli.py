"""python -m millrace.cli WAREHOUSE [mock_table | bench_without_table | bench | delete_table]

Makes a mock table, compacts it and prints what that did. `bench`, also if nothing is named, does all three steps.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from millrace.fixtures import MockTable, mock_table
from millrace.orchestrate import Compaction
from millrace.plans.config import CompactionConfig
from millrace.sources.table import Catalog

TABLE = "mock"


def bench(catalog: Catalog) -> dict[str, int]:
    began = time.perf_counter()
    result = Compaction(catalog, TABLE, CompactionConfig()).compact()
    s = result.stats if result else None
    return {
        "input_files": s.input_files_count if s else 0, "output_files": s.output_files_count if s else 0, "input_bytes": s.input_total_bytes if s else 0, "output_bytes": s.output_total_bytes if s else 0,
        "milliseconds": round((time.perf_counter() - began) * 1000),
    }


def main(args: list[str], spark: SparkSession | None = None, spec: MockTable = MockTable()) -> dict[str, int] | None:
    if not args:
        sys.exit(__doc__)
    catalog = Catalog(spark or SparkSession.builder.getOrCreate(), args[0])
    step, out = args[1] if len(args) > 1 else "bench", None
    if step not in ("delete_table", "bench_without_table"):
        mock_table(catalog, TABLE, spec)
    if step not in ("delete_table", "mock_table"):
        out = bench(catalog)
        print(", ".join(f"{k} {v}" for k, v in out.items()))
    if step not in ("mock_table", "bench_without_table"):
        catalog.drop_table(TABLE)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
