"""Gridded analyses as a stream: a batch holds the files that have landed in a folder since the last one.

An offset is the landing time and name of the newest file taken; a file is taken once it has been there for ``settle``
seconds, so that none that lands with the same time as another is passed over. Files are listed by the driver, decoded
where tasks run, one task for each, and only in the variables and levels asked for. Analyses that land late, of an older
cycle, are taken as any other. Streams start from the first file, or with ``newest`` from the newest cycle there is.
"""

from __future__ import annotations

import importlib
import re
import time

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import filesystem
from .grid_source import FIELDS


class _Landed(InputPartition):
    def __init__(self, path: str, cycle: str):
        self.path, self.cycle = path, cycle


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the option path is missing")
        self.path, self.settle = options["path"].rstrip("/"), float(options.get("settle", "2"))
        self.pattern = re.compile(options.get("pattern", r"(\d{8})_?(\d{2})"))
        self.newest, self.most = options.get("newest", "false").lower() == "true", int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", "64")))
        module, _, name = options.get("decoder", "windrose.sources.grid_source:parquet_decoder").partition(":")
        self.module, self.name = module, name
        listed = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        self.variables, self.levels = set(listed("variables")) or None, {float(x) for x in listed("levels")} or None
        self.taken: tuple[int, str] | None = None

    def _files(self) -> list[tuple[int, str, str]]:
        """(landing time in ns, name, cycle) of the settled files, in that order; names without a cycle are passed over."""
        from pyarrow import fs as arrow

        fs, root = filesystem(self.path)
        before = (time.time() - self.settle) * 1e9
        found = []
        for info in fs.get_file_info(arrow.FileSelector(root, allow_not_found=True)):
            base = info.base_name
            if info.type.name == "NotFound" or base.startswith((".", "_")) or info.mtime_ns is None or info.mtime_ns > before:
                continue
            if m := self.pattern.search(base):
                found.append((info.mtime_ns, base, "".join(m.groups())))
        return sorted(found)

    def initialOffset(self) -> dict:
        if self.newest and (files := self._files()):
            cycle = max(c for _, _, c in files)
            older = [f for f in files if f[2] < cycle]
            return {"landed": older[-1][0], "name": older[-1][1], "from": cycle} if older else {"landed": 0, "name": "", "from": cycle}
        return {"landed": 0, "name": "", "from": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        since = self.taken
        if since is None:
            since = (0, "")
        fresh = [f for f in files if f[:2] > since][: self.most]
        if fresh:
            self.taken = fresh[-1][:2]
        landed, name = self.taken or since
        return {"landed": landed, "name": name, "from": ""}

    def partitions(self, start: dict, end: dict):
        low, high = (start["landed"], start["name"]), (end["landed"], end["name"])
        self.taken = max(self.taken or high, high)
        return [_Landed(f"{self.path}/{name}", cycle) for landed, name, cycle in self._files() if low < (landed, name) <= high and cycle >= start.get("from", "")]

    def read(self, partition):
        decode = getattr(importlib.import_module(self.module), self.name)
        for batch in decode(partition.path, self.variables, self.levels):
            n = batch.num_rows
            columns = [batch.column(batch.schema.get_field_index(c)).cast(kind) for c, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.cycle] * n, pa.string()), *columns], names=["path", "cycle", *FIELDS])

    def commit(self, end: dict) -> None:
        pass


class GridStream(DataSource):
    """Options: path, variables, levels, decoder, pattern (two groups: date and hour), settle, newest, maxFilesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "grid_stream"

    def schema(self) -> str:
        return "path string, cycle string, variable string, lev double, lat double, lon double, value double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({**{k.lower(): v for k, v in self.options.items()}, **self.options})


def register(spark) -> None:
    spark.dataSource.register(GridStream)
