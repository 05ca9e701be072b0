"""``spark.read.format("archive_entries")``: the entries of the archives below a folder that all executors see.

A partition is a range of files; only their own bytes are read.  Equality filters on format_id reach the reader."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from .archives import default_registry
from .tables import ENTRY


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class EntryReader(DataSourceReader):
    def __init__(self, root: str, per_task: int) -> None:
        self.root, self.per_task, self.formats = root, per_task, None

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("format_id",):
                self.formats = {f.value} if self.formats is None else self.formats & {f.value}
            else:
                yield f

    def partitions(self):
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if not os.path.islink(os.path.join(d, n)))
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition):
        known = default_registry()
        if self.formats is not None:
            known.readers = [r for r in known.readers if r.format_id in self.formats]
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    data = f.read()
                reader, entries, _, _ = known.open(data, path)
            except Exception:  # noqa: BLE001  one file doesn't stop the others
                continue
            for i, e in enumerate(entries):
                yield (path, reader.format_id, i, e.entry_id, e.path, e.raw_path, e.size, e.size_known, e.packed_size, e.compressed, e.encrypted, e.offset, e.checksum)


class ArchiveEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema):  # noqa: ARG002
        return EntryReader(self.options["path"], int(self.options.get("filesPerTask", 16)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveEntries)
