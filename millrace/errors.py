"""Errors of the engine; each kind has a fixed prefix."""

from __future__ import annotations


# The prefixes.


class CompactionError(Exception):
    prefix = ""

    def __init__(self, message: object = "") -> None:
        self.message = str(message)
        super().__init__(f"{self.prefix}{self.message}")


class IoError(CompactionError):
    prefix = "IO error: "


class ConfigError(CompactionError):
    prefix = "Invalid configuration: "


class ExecutionError(CompactionError):
    prefix = "Execution failed: "


class TableError(CompactionError):
    prefix = "Table error: "


class CommitConflict(TableError):
    """Another commit came first; the commit may be tried again."""


class SchemaChanged(TableError):
    """The table's schema is not the one that was planned with; trying again does not help."""


class EngineError(CompactionError):
    prefix = "Engine error: "


class TestError(CompactionError):
    prefix = "Test error: "
    __test__ = False


class ValidationError(CompactionError):
    prefix = "Compaction validator failed: "


class UnexpectedError(CompactionError):
    prefix = "Compaction unexpected failed: "
