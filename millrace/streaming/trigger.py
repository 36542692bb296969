"""Appending a stream to a table, and compacting it from the stream when the planner says so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.model import CompactionResult
from millrace.orchestrate import AutoCompaction
from millrace.plans.config import AutoCompactionConfig
from millrace.sources.table import MAIN, Catalog

BATCH = "stream-batch-id"


@dataclass
class CompactingSink:
    """For writeStream.foreachBatch: every micro-batch is one append, and every `every` batches auto compaction runs.

    A batch that was appended already (its number is in the summary of one of the branch's snapshots) is skipped, so a restart
    after a failure between append and checkpoint adds nothing twice, whoever else commits. Streams that share a
    branch need names of their own.
    """

    catalog: Catalog
    table_name: str
    config: AutoCompactionConfig = AutoCompactionConfig()
    every: int = 10
    branch: str = MAIN
    stream: str = ""
    on_result: Callable[[CompactionResult], None] | None = None
    results: list[CompactionResult] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        table = self.catalog.load_table(self.table_name)
        key = f"{BATCH}-{self.stream}" if self.stream else BATCH
        done = max((int(s.summary.get(key, "-1")) for s in table.metadata.history(self.branch)), default=-1)
        if batch_id > done and not batch.isEmpty():
            table.append(batch, self.branch, {key: str(batch_id)})
        if self.every and (batch_id + 1) % self.every == 0:
            result = AutoCompaction(self.catalog, self.table_name, self.config, to_branch=self.branch).compact()
            if result is not None:
                self.results.append(result)
                if self.on_result:
                    self.on_result(result)
