"""Gridded files in the classic NetCDF formats: a decoder for the grid sources, and patches written as files.

The decoder reads the header and then only the byte ranges of the variables and levels asked for. Values are decoded as
the CF conventions have it (fill and missing values, scale, offset); other attributes, such as a stored dtype, are ignored.
Files of the HDF5-based format need a library of their own.

patch_files() writes one file for each patch, by the task that holds the patch, under a name of its own: a file counts if
the manifest that comes back lists it.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import filesystem

# Fixed values of the format: tags, and types by their number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Names that files have for the axes.
AXES = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "lev": ("lev", "level", "plev", "isobaricInhPa")}
HEADER_BYTES = 1 << 20


class _Bytes:
    """A header's numbers and names, one after the other."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3:4] not in (b"\x01", b"\x02", b"\x05"):
            raise ValueError("not a file of the classic NetCDF formats")
        self.data, self.at, self.version = data, 4, data[3]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the header ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int = 0) -> int:
        size = size or (8 if self.version == 5 else 4)
        return int.from_bytes(self.take(size), "big")

    def text(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode()

    def listed(self, tag: int) -> int:
        kind, n = self.number(4), self.number()
        if kind not in (0, tag) or (not kind and n):
            raise ValueError("the header is broken")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTES)):
            name, kind, n = self.text(), self.number(4), self.number()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.take(size + -size % 4)[:size]
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out


class Classic:
    """The header of a file: dimensions (name, size), and variables by name: dims, attributes, type, begin, step (of a record)."""

    def __init__(self, read):
        """``read``: from a place, some bytes."""
        size = 1 << 13
        while True:
            data = read(0, size)
            try:
                self._parse(_Bytes(data))
                break
            except ValueError:
                if len(data) < size or size >= HEADER_BYTES:
                    raise
                size *= 4
        self.read = read

    def _parse(self, b: _Bytes) -> None:
        records = b.number()
        self.dims = [(b.text(), b.number()) for _ in range(b.listed(DIMENSIONS))]
        self.attributes = b.attributes()
        self.variables, widths = {}, []
        for _ in range(b.listed(VARIABLES)):
            name, dims = b.text(), [b.number() for _ in range(b.number())]
            attributes, kind = b.attributes(), b.number(4)
            b.number()  # its size, which is too small a number for large variables
            begin = b.number(4 if b.version == 1 else 8)
            lengths = [self.dims[d][1] for d in dims]
            record = bool(dims) and lengths[0] == 0
            width = math.prod(lengths[1:] if record else lengths) * np.dtype(TYPES[kind]).itemsize
            widths += [width] * record
            self.variables[name] = {"dims": [self.dims[d][0] for d in dims], "shape": ([records] if record else lengths[:1]) + lengths[1:], "attributes": attributes, "type": np.dtype(TYPES[kind]), "begin": begin, "record": record, "width": width}
        # the records of several variables follow one another, each padded; a single one's aren't
        self.step = widths[0] if len(widths) == 1 else sum(w + -w % 4 for w in widths)

    def values(self, name: str, first: int | None = None) -> np.ndarray:
        """A variable, or its part at one place of its first dimension, decoded; places with no value are NaN."""
        v = self.variables[name]
        shape, size = list(v["shape"]), v["type"].itemsize
        if v["record"]:
            at = range(shape[0]) if first is None else [first]
            raw = b"".join(self.read(v["begin"] + i * self.step, v["width"]) for i in at)
            shape = shape if first is None else shape[1:]
        else:
            shape = shape if first is None else shape[1:]
            n = math.prod(shape) * size
            raw = self.read(v["begin"] + (first or 0) * n, n)
        x = np.frombuffer(raw, v["type"])
        if len(x) != math.prod(shape):
            raise ValueError(f"{name} ends too early")
        if v["type"].kind == "S":
            return x.reshape(shape)
        out, about = x.astype(float), v["attributes"]
        for key in ("_FillValue", "missing_value"):
            if key in about and not isinstance(about[key], str):
                out[np.isin(x, about[key].astype(v["type"]))] = np.nan
        of = lambda key, default: float(about[key][0]) if key in about and not isinstance(about[key], str) else default
        return (out * of("scale_factor", 1.0) + of("add_offset", 0.0)).reshape(shape)


def opened(path: str) -> Classic:
    fs, there = filesystem(path)
    file = fs.open_input_file(there)
    return Classic(lambda at, n: file.read_at(n, at))


def decoder(path: str, variables: set[str] | None, levels: set[float] | None) -> Iterator[pa.RecordBatch]:
    """For the grid sources (``windrose.sources.netcdf:decoder``): a batch of variable, lev, lat, lon and value for each
    level of each variable over latitude and longitude. Dimensions of one place, such as a time, are passed over."""
    file = opened(path)
    axis = {name: next((n for n in names if n in file.variables), None) for name, names in AXES.items()}
    if axis["lat"] is None or axis["lon"] is None:
        raise ValueError(f"{path} has no latitudes and longitudes")
    lat, lon = file.values(axis["lat"]), file.values(axis["lon"])
    wide = (np.repeat(lat, len(lon)), np.tile(lon, len(lat)))
    for name, v in file.variables.items():
        dims = [d for d, n in zip(v["dims"], v["shape"], strict=True) if n != 1 or d in axis.values()]
        if (variables and name not in variables) or dims[-2:] != [axis["lat"], axis["lon"]] or len(dims) > 3 or (len(dims) == 3 and dims[0] != axis["lev"]):
            continue
        heights = file.values(axis["lev"]) if len(dims) == 3 else [None]
        first = v["dims"][0] == dims[0]  # else a dimension of one place comes before, and the variable is read as a whole
        whole = None if first and len(dims) == 3 else file.values(name).reshape(len(heights), -1)
        for i, lev in enumerate(heights):
            if levels and lev not in levels:
                continue
            value = (file.values(name, i) if whole is None else whole[i]).ravel()
            n = len(value)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([None if lev is None else float(lev)] * n, pa.float64()), *map(pa.array, (*wide, value))], names=["variable", "lev", "lat", "lon", "value"])


def packed(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A file of the format with 64-bit offsets. ``variables``: name to dimensions, values and attributes (texts and numbers);
    values are of 32 or 64-bit floats or 32-bit whole numbers."""
    number = lambda n: struct.pack(">I", n)
    text = lambda s: number(len(s.encode())) + s.encode() + bytes(-len(s.encode()) % 4)
    kind_of = {"f4": 5, "f8": 6, "i4": 4}

    def noted(found: dict) -> bytes:
        out = number(ATTRIBUTES) + number(len(found)) if found else bytes(8)
        for name, value in found.items():
            if isinstance(value, str):
                out += text(name) + number(2) + text(value)
            else:
                out += text(name) + number(6) + number(1) + struct.pack(">d", value)
        return out

    order = list(dims)
    arrays = {name: np.ascontiguousarray(v[1]).astype(">" + v[1].dtype.str[1:]) for name, v in variables.items()}

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + number(0) + (number(DIMENSIONS) + number(len(dims)) if dims else bytes(8))
        out += b"".join(text(n) + number(s) for n, s in dims.items()) + noted(attributes or {})
        out += number(VARIABLES) + number(len(variables)) if variables else bytes(8)
        for name, (over, _, about) in variables.items():
            size = arrays[name].nbytes
            out += text(name) + number(len(over)) + b"".join(number(order.index(d)) for d in over) + noted(about)
            out += number(kind_of[arrays[name].dtype.str[1:]]) + number(min(size + -size % 4, 2**32 - 1)) + struct.pack(">Q", begins[name])
        return out

    begins, at = {}, len(header(dict.fromkeys(variables, 0)))
    for name, a in arrays.items():
        begins[name] = at
        at += a.nbytes + -a.nbytes % 4
    return header(begins) + b"".join(a.tobytes() + bytes(-a.nbytes % 4) for a in arrays.values())


def _patch(group: pa.Table, name_of) -> tuple[str, bytes]:
    """A patch's cells as a file: latitudes and longitudes ascend, levels descend; places without a cell are NaN."""
    frame = group.select(["variable", "lev", "lat", "lon", "value"]).to_pandas()
    lat, lon = np.unique(frame["lat"]), np.unique(frame["lon"])
    lev = np.unique(frame["lev"].dropna())[::-1]
    dims = ({"lev": len(lev)} if len(lev) else {}) | {"lat": len(lat), "lon": len(lon)}
    out = {a: ([a], x.astype(float), {}) for a, x in (("lev", lev), ("lat", lat), ("lon", lon)) if len(x)}
    for name, part in frame.groupby("variable", sort=True):
        flat = part["lev"].isna().all()
        values = np.full((1 if flat else len(lev), len(lat), len(lon)), np.nan, np.float32)
        k = 0 if flat else np.searchsorted(-lev, -part["lev"].to_numpy())
        values[k, np.searchsorted(lat, part["lat"]), np.searchsorted(lon, part["lon"])] = part["value"]
        out[name] = (["lat", "lon"], values[0], {}) if flat else (["lev", "lat", "lon"], values, {})
    return name_of(group), packed(dims, out)


def patch_files(cells: DataFrame, folder: str, *, keys: list[str]) -> DataFrame:
    """Writes a file for each patch into ``folder``; its manifest: the keys, name and bytes of each.

    ``cells``: the keys of the patch, variable, lev (null: none), lat, lon and value, as training.in_patches gives them with
    fields. A variable has levels in all of its rows or in none. The manifest is evaluated when it is first used: write it
    down, as each use writes the patches again, under other names.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(group: pa.Table) -> pa.Table:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, data = _patch(group, lambda g: "_".join(str(g[k][0].as_py()).replace("/", "-") for k in keys) + f"-{uuid.uuid4().hex}.nc")
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        return pa.table({**{k: group[k].slice(0, 1) for k in keys}, "name": [name], "bytes": pa.array([len(data)], pa.int64())})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", name string, bytes long"
    plain = cells.select(*keys, "variable", *[F.col(c).cast("double").alias(c) for c in ("lev", "lat", "lon", "value")])
    return plain.groupBy(*keys).applyInArrow(run, schema)
