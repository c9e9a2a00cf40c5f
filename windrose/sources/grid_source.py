"""A batch data source of gridded analyses: one input partition per file, filters on variable and level pushed down.

``path`` is a file or a folder, ``paths`` several, as a JSON list or with commas between. Files are decoded where tasks
run, by a decoder named as ``module:function``: it takes a path and the wanted (variables, levels) and yields Arrow
batches of variable, lev (null for the surface), lat, lon and value. The decoder in this module reads the long form from
Parquet; ones for GRIB and NetCDF need libraries of their own and are given by the user. Paths that Arrow's file systems
don't know go to the decoder as they are.

A file that can't be decoded to its end fails the query (FAILFAST) or, under PERMISSIVE, gives a single row of its path
and the error and none of what was read of it.
"""

from __future__ import annotations

import importlib
import json

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .files import filesystem

FIELDS = {"variable": pa.string(), "lev": pa.float64(), "lat": pa.float64(), "lon": pa.float64(), "value": pa.float64()}


def parquet_decoder(path: str, variables: set[str] | None, levels: set[float] | None):
    import pyarrow.dataset as ds

    keep = None
    for name, values in (("variable", variables), ("lev", levels)):
        if values:
            wanted = ds.field(name).isin(sorted(values))
            keep = wanted if keep is None else keep & wanted
    fs, there = filesystem(path)
    yield from ds.dataset(there, filesystem=fs).to_batches(columns=list(FIELDS), filter=keep)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        given = options.get("paths", "")
        self.paths = json.loads(given) if given.startswith("[") else [p for p in given.split(",") if p] or [p for p in [options.get("path", "")] if p]
        module, _, name = options.get("decoder", "windrose.sources.grid_source:parquet_decoder").partition(":")
        self.module, self.name, self.strict = module, name, options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.variables: set[str] | None = None
        self.levels: set[float] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("variable",):
                self.variables = values
            elif values is not None and f.attribute == ("lev",):
                self.levels = {float(v) for v in values}
            yield f  # checked again by Spark

    def partitions(self):
        """A folder stands for the files in it, in the order of their names; hidden ones are passed over."""
        from pyarrow import fs as arrow

        found = []
        for path in self.paths:
            try:
                fs, there = filesystem(path)
            except (ValueError, OSError):
                found.append(path)
                continue
            info = fs.get_file_info(there)
            if info.type.name != "Directory" or fs.get_file_info(f"{there}/_SUCCESS").type.name == "File":
                found.append(path)  # a file, or one table in several
                continue
            names = sorted(i.base_name for i in fs.get_file_info(arrow.FileSelector(there)) if not i.base_name.startswith((".", "_")))
            found += [f"{path.rstrip('/')}/{n}" for n in names]
        return [_File(p) for p in found]

    def read(self, partition):
        decode = getattr(importlib.import_module(self.module), self.name)
        whole = (self._named(partition.path, b) for b in decode(partition.path, self.variables, self.levels))
        if self.strict:
            yield from whole
            return
        try:
            held = list(whole)  # of one file
        except Exception as e:
            held = [self._row(partition.path, str(e))]
        yield from held

    @staticmethod
    def _named(path: str, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [batch.column(batch.schema.get_field_index(c)).cast(kind) for c, kind in FIELDS.items()]
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *columns, pa.nulls(n, pa.string())], names=["path", *FIELDS, "error"])

    @staticmethod
    def _row(path: str, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), *[pa.nulls(1, kind) for kind in FIELDS.values()], pa.array([error])], names=["path", *FIELDS, "error"])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "path string, variable string, lev double, lat double, lon double, value double, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
