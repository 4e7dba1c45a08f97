"""Versions of a table as plain parquet folders plus a small log.

``root/v=<n>`` holds a snapshot, ``root/log`` one JSON row per commit or
rollback. A draft is a DataFrame tied to the version that it changes, until it
is confirmed or discarded. The log has one row per edit and is read on the
driver.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.diff import table_diff

_LOG = (
    "seq long, action string, version long, index long, tag string, created string, message string, "
    "kind string, trace string, row_count long, column_count long"
)


@dataclass
class Draft:
    """A change that is not committed. ``base`` is the version number it was made on."""

    versions: VersionedTable
    table: DataFrame
    base: int
    message: str
    kind: str
    trace: str = ""
    open: bool = True

    def diff(self, key: str = "_rid") -> DataFrame:
        """``table_diff`` against the active version, and ``active_version``, its number."""
        changes = table_diff(self.versions.current(), self.table, key)
        return changes.withColumn("active_version", F.lit(self.versions.active_version()).cast("long"))

    def confirm(self) -> DataFrame:
        """Commit the draft; an error if it is closed or another version became active."""
        self._close()
        if self.versions.active_version() != self.base:
            raise ValueError("another version became active; make the draft again")
        return self.versions.commit(self.table, self.message, self.kind, self.trace)

    def discard(self) -> DataFrame:
        """Drop the draft; returns the active version."""
        self._close()
        return self.versions.current()

    def _close(self) -> None:
        if not self.open:
            raise ValueError("the draft is closed")
        self.open = False


class VersionedTable:
    """Commit, look back, roll back. Version numbers only ever grow."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # log

    def _events(self) -> list:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.root}/log").orderBy("seq").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def _replay(self) -> tuple[list, int, int, int]:
        """The commits in force, the active index, and the next numbers."""
        commits, active, seq, version = [], -1, 0, 0
        for event in self._events():
            seq = event["seq"]
            if event["action"] == "commit":
                commits = [*commits[: active + 1], event]
                active, version = len(commits) - 1, event["version"]
            else:
                active = event["index"]
        return commits, active, seq + 1, version + 1

    def _write(self, **event: object) -> None:
        names = [part.split()[0] for part in _LOG.split(", ")]
        kinds = dict(part.split() for part in _LOG.split(", "))
        row = self.spark.range(1).select(*[F.lit(event.get(n)).cast(kinds[n]).alias(n) for n in names])
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")

    # operators

    def commit(self, df: DataFrame, message: str, kind: str, trace: str = "") -> DataFrame:
        """Store ``df`` as the active version; versions after the active one are
        dropped from the history. Returns the stored table."""
        commits, active, seq, version = self._replay()
        path = f"{self.root}/v={version}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        tag = "v1_initial" if version == 1 else f"v{version}_{kind.lower()}"
        self._write(
            seq=seq,
            action="commit",
            version=version,
            index=active + 1,
            tag=tag,
            created=datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"),
            message=message,
            kind=kind,
            trace=trace,
            row_count=stored.count(),
            column_count=len(df.columns),
        )
        return stored

    def draft(self, df: DataFrame, message: str, kind: str, trace: str = "") -> Draft:
        """A change of the active version, to look at, confirm or discard."""
        return Draft(self, df, self.active_version(), message, kind, trace)

    def active_version(self) -> int:
        commits, active, _, _ = self._replay()
        if active < 0:
            raise ValueError("nothing committed yet")
        return commits[active]["version"]

    def current(self) -> DataFrame:
        commits, active, _, _ = self._replay()
        if active < 0:
            raise ValueError("nothing committed yet")
        return self.spark.read.parquet(f"{self.root}/v={commits[active]['version']}")

    def rollback(self, index: int) -> DataFrame:
        """Make an earlier version active; an index out of range changes nothing."""
        commits, active, seq, _ = self._replay()
        if 0 <= index < len(commits) and index != active:
            self._write(seq=seq, action="rollback", index=index)
        return self.current()

    def undo(self) -> DataFrame:
        """Back to the version before the active one."""
        return self.rollback(self._replay()[1] - 1)

    def reset(self) -> DataFrame:
        """Back to the first version."""
        return self.rollback(0)

    def history(self) -> DataFrame:
        """One row per version in force, oldest first, with the active one marked."""
        commits, active, _, _ = self._replay()
        rows = [(i, *[c[n] for n in _HISTORY[1:]], i == active) for i, c in enumerate(commits)]
        return self.spark.createDataFrame(rows, _HISTORY_SCHEMA)


_HISTORY = ["index", "version", "tag", "created", "message", "kind", "trace", "row_count", "column_count"]
_HISTORY_SCHEMA = (
    "index long, version long, tag string, created string, message string, kind string, trace string, "
    "row_count long, column_count long, active boolean"
)
