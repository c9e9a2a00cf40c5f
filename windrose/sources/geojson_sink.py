"""A data source that writes GeoJSON: tasks write whole documents, the commit makes them visible and moves ``latest`` last.

Every task writes one FeatureCollection, under a name of its own in a staging folder. The driver gets the names only. When
all tasks have ended, a single document is renamed to ``<name>.geojson``, several become a folder ``<name>`` with a
manifest that lists them, in the order of the partitions; then ``latest_<latest>`` is replaced in one step by a copy of
the document or the manifest. A task that fails, or that runs twice, leaves nothing that a document or manifest names, and
an aborted job removes its staging folder and leaves the last ``latest`` as it was.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import filesystem


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    features: int


def _plain(value):
    """A value as JSON has it; numbers that aren't finite are null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, bool | int | str) else str(value)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        for need in ("path", "name"):
            if not options.get(need):
                raise ValueError(f"the option {need} is missing")
        self.path, self.name, self.latest = options["path"].rstrip("/"), options["name"], options.get("latest")
        self.lat, self.lon = options.get("latitude", "latitude"), options.get("longitude", "longitude")
        if not {self.lat, self.lon} <= set(columns):
            raise ValueError(f"no columns {self.lat} and {self.lon}")
        self.prefix = [p for p in options.get("flatten", "").split(",") if p]
        self.metadata = json.loads(options.get("metadata", "{}"))
        self.job = uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{self.path}/.staging-{self.job}"

    def _feature(self, row) -> str:
        values = row.asDict()
        place = [_plain(values.pop(self.lon)), _plain(values.pop(self.lat))]
        for name in self.prefix:  # a map becomes properties of its own
            for key, value in sorted((values.pop(name, None) or {}).items()):
                values[f"{name}_{key}"] = value
        return json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": place}, "properties": _plain(values)}, allow_nan=False)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, folder = filesystem(self._staging())
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        name, n = f"part-{number:05}-{uuid.uuid4().hex}.geojson", 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            out.write(('{"type": "FeatureCollection", "metadata": ' + json.dumps(self.metadata) + ', "features": [').encode())
            for row in iterator:
                out.write((("," if n else "") + "\n" + self._feature(row)).encode())
                n += 1
            out.write(b"\n]}\n")
        return _Part(number, name, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        kept = [m for m in parts if m.features] or parts[:1]
        fs, folder = filesystem(self._staging())
        _, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if len(kept) == 1:
            shown = f"{root}/{self.name}.geojson"
            fs.move(f"{folder}/{kept[0].name}", shown)
        elif kept:
            data = f"{self.name}-{self.job}"
            fs.create_dir(f"{root}/{data}", recursive=True)
            for m in kept:
                fs.move(f"{folder}/{m.name}", f"{root}/{data}/{m.name}")
            shown = f"{root}/{self.name}.manifest.json"
            document = {"metadata": self.metadata, "features": sum(m.features for m in kept), "documents": [f"{data}/{m.name}" for m in kept]}
            self._replace(fs, shown, json.dumps(document).encode())
        if kept and self.latest:
            end = ".geojson" if len(kept) == 1 else ".manifest.json"
            with fs.open_input_file(shown) as held:
                self._replace(fs, f"{root}/latest_{self.latest}{end}", held)
        if fs.get_file_info(folder).type.name != "NotFound":
            fs.delete_dir(folder)

    def _replace(self, fs, path: str, content) -> None:
        """Written under another name and renamed; ``content`` is bytes or an open file, copied piece by piece."""
        staged = f"{path}.{self.job}.tmp"
        with fs.open_output_stream(staged) as out:
            if isinstance(content, bytes):
                out.write(content)
            else:
                while piece := content.read(1 << 20):
                    out.write(piece)
        fs.move(staged, path)

    def abort(self, messages) -> None:
        fs, folder = filesystem(self._staging())
        if fs.get_file_info(folder).type.name != "NotFound":
            fs.delete_dir(folder)


class GeoJsonSink(DataSource):
    """Options: path, name, latest, metadata (JSON), latitude, longitude, flatten (map columns, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "geojson"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields])


def register(spark) -> None:
    spark.dataSource.register(GeoJsonSink)
