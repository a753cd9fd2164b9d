"""NetCDF classic files (versions 1, 2 and 5) as a Spark data source: cubes in long form, read by file and slab of time.

A partition is some steps of one file, and of each step only the rows of latitudes that are asked for are read. Files are
opened by pyarrow's file systems, so a path may be local or a URI. NetCDF-4 files are HDF5, for which no library is here; they are an error.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from typing import Any, BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format: external types by number, and tags of the header's lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Values that mean "never written" by external type, where a variable names none.
FILLS = {">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">i8": -9223372036854775806}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


class Variable(NamedTuple):
    dims: tuple[str, ...]
    attributes: dict[str, Any]
    kind: str
    begin: int


class Header(NamedTuple):
    """sizes by dimension; the unlimited dimension, if any, with its records interleaved `stride` bytes apart."""

    sizes: dict[str, int]
    unlimited: str | None
    variables: dict[str, Variable]
    stride: int


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def paths_of(pattern: str) -> list[str]:
    """Files of a comma-separated list of files, folders and patterns with * and ? in the last part, in order of their names."""
    from fnmatch import fnmatch

    from pyarrow import fs

    out = []
    for one in filter(None, (p.strip() for p in pattern.split(","))):
        system, inner = fs.FileSystem.from_uri(one) if re.match(r"[a-zA-Z][\w+.-]+:", one) else (fs.LocalFileSystem(), one)
        prefix = one[: len(one) - len(inner)] if one.endswith(inner) else ""
        folder, _, name = inner.rpartition("/")
        if re.search(r"[*?\[]", name):
            found = [f.path for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.type == fs.FileType.File and fnmatch(f.base_name, name)]
        else:
            (info,) = system.get_file_info([inner])
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(one)
            found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File] if info.type == fs.FileType.Directory else [inner]
        out += [prefix + f for f in sorted(found)]
    return out


def read_header(file: BinaryIO) -> Header:
    magic = file.read(4)
    if magic[:4] == b"\x89HDF":
        raise ValueError("this is NetCDF-4 (HDF5), which can't be read here; convert it to the classic format")
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("this is no NetCDF classic file")
    wide = magic[3] == 5

    def number(code: str) -> int:
        return struct.unpack(f">{code}", file.read(struct.calcsize(code)))[0]

    count = lambda: number("q" if wide else "i")

    def name() -> str:
        n = count()
        return file.read(n + -n % 4)[:n].decode()

    def listed(tag: int) -> range:
        found, n = number("i"), count()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError("the header is damaged")
        return range(n)

    def attributes() -> dict[str, Any]:
        out = {}
        for _ in listed(ATTRIBUTES):
            key, kind, n = name(), TYPES[number("i")], count()
            size = n * np.dtype(kind).itemsize
            raw = file.read(size + -size % 4)[:size]
            out[key] = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
        return out

    records = number("q" if wide else "i")
    dims = [(name(), count()) for _ in listed(DIMENSIONS)]
    attributes()
    variables, by_record = {}, []
    for _ in listed(VARIABLES):
        key = name()
        of = tuple(dims[count()][0] for _ in range(count()))
        extra, kind, size = attributes(), TYPES[number("i")], count()
        variables[key] = Variable(of, extra, kind, number("i" if magic[3] == 1 else "q"))
        if of and dict(dims)[of[0]] == 0:
            by_record.append((size, int(np.prod([s for d, s in dims if d in of[1:]], initial=1)) * np.dtype(kind).itemsize))
    unlimited = next((d for d, n in dims if n == 0), None)
    # One record variable alone isn't padded.
    stride = by_record[0][1] if len(by_record) == 1 else sum(size for size, _ in by_record)
    if unlimited and records < 0:
        raise ValueError("the number of records isn't known")
    return Header({d: records if d == unlimited else n for d, n in dims}, unlimited, variables, stride)


def read_part(file: BinaryIO, header: Header, name: str, step: int | None = None, rows: tuple[int, int] | None = None) -> np.ndarray:
    """A variable, or one step of its first dimension, or rows of the second one in that step; raw values."""
    v = header.variables[name]
    shape = [header.sizes[d] for d in v.dims]
    size = np.dtype(v.kind).itemsize
    if step is None:
        if v.dims and v.dims[0] == header.unlimited:
            return np.concatenate([read_part(file, header, name, k)[None] for k in range(shape[0])]) if shape[0] else np.zeros(shape, v.kind)
        file.seek(v.begin)
        return np.frombuffer(file.read(int(np.prod(shape, initial=1)) * size), v.kind).reshape(shape)
    inner = shape[1:]
    whole = int(np.prod(inner, initial=1)) * size
    begin = v.begin + step * (header.stride if v.dims[0] == header.unlimited else whole)
    if rows is not None:
        line = int(np.prod(inner[1:], initial=1)) * size
        begin, whole, inner = begin + rows[0] * line, (rows[1] - rows[0]) * line, [rows[1] - rows[0], *inner[1:]]
    file.seek(begin)
    return np.frombuffer(file.read(whole), v.kind).reshape(inner)


def cleaned(raw: np.ndarray, v: Variable) -> np.ndarray:
    """Doubles with scale and offset applied; fill values, values outside the valid range and what isn't finite are NaN."""
    out = raw.astype(float)
    one = lambda key: np.asarray(v.attributes[key]).ravel() if key in v.attributes and not isinstance(v.attributes[key], str) else np.zeros(0)
    missing = [*one("_FillValue"), *one("missing_value")] or [FILLS[v.kind]] * (v.kind in FILLS)
    for m in missing:
        out[raw == np.asarray(m).astype(raw.dtype)] = math.nan
    low, high = (one("valid_range") if len(one("valid_range")) == 2 else [next(iter(one(k)), None) for k in ("valid_min", "valid_max")])
    for bound, beyond in ((low, np.less), (high, np.greater)):
        if bound is not None:
            out[beyond(raw, bound)] = math.nan
    out = out * next(iter(one("scale_factor")), 1.0) + next(iter(one("add_offset")), 0.0)
    out[~np.isfinite(out)] = math.nan
    return out


def times_of(values: np.ndarray, units: str | None) -> list[datetime]:
    """Times from 'hours since 1990-01-01 00:00:00' and the like, in the usual calendar."""
    found = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{1,4}-\d{1,2}-\d{1,2})(?:[T ]+(\d{1,2}:\d{2}(?::\d{2})?))?", units or "")
    if not found:
        raise ValueError(f"times in {units!r} can't be read")
    year, month, day = map(int, found[2].split("-"))
    clock = [int(x) for x in (found[3] or "0:0").split(":")]
    start = datetime(year, month, day, *clock)
    return [start + timedelta(microseconds=round(float(x) * UNITS[found[1]] * 1e6)) for x in values]


class Slab(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class CubeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: Any):
        self.options, self.names = options, [f.name for f in schema.fields]
        self.bounds = {"lat": [-math.inf, math.inf], "time": [datetime.min, datetime.max]}
        for key, end in (("lat_min", 0), ("lat_max", 1)):
            if key in options:
                self.bounds["lat"][end] = float(options[key])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of lat and time are kept for the partitions and the reads; Spark applies all filters again."""
        for f in filters:
            name, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            if name in self.bounds and value is not None:
                value = float(value) if name == "lat" else value.replace(tzinfo=None) if isinstance(value, datetime) else None
                if value is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.bounds[name][0] = max(self.bounds[name][0], value)
                if value is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.bounds[name][1] = min(self.bounds[name][1], value)
            yield f

    def _axes(self, file: BinaryIO, header: Header) -> tuple[list[datetime], np.ndarray, np.ndarray]:
        time, lat, lon = (self.options.get(f"{a}_name", a) for a in ("time", "lat", "lon"))
        units = header.variables[time].attributes.get("units")
        return times_of(read_part(file, header, time).ravel(), units), *(read_part(file, header, a).astype(float) for a in (lat, lon))

    def partitions(self) -> Sequence[InputPartition]:
        """Headers and time axes are read here; slabs without a step in the time bounds are left out."""
        slab, out = int(self.options.get("slab", 24)), []
        for path in paths_of(self.options["path"]):
            with _open(path) as file:
                times, _, _ = self._axes(file, read_header(file))
            for k in range(0, len(times), slab):
                if any(self.bounds["time"][0] <= t <= self.bounds["time"][1] for t in times[k : k + slab]):
                    out.append(Slab(path, k, min(k + slab, len(times))))
        return out or [Slab("", 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as file:
            header = read_header(file)
            times, lat, lon = self._axes(file, header)
            wanted = np.flatnonzero((lat >= self.bounds["lat"][0]) & (lat <= self.bounds["lat"][1]))
            if not len(wanted):
                return
            lat_name, lon_name = (self.options.get(f"{a}_name", a) for a in ("lat", "lon"))
            rows = int(wanted[0]), int(wanted[-1]) + 1
            values = [n for n in self.names if n not in ("time", "lat", "lon")]
            y, x = np.repeat(lat[rows[0] : rows[1]], len(lon)), np.tile(lon, rows[1] - rows[0])
            for k in range(partition.first, partition.last):
                if not self.bounds["time"][0] <= times[k] <= self.bounds["time"][1]:
                    continue
                columns = {"time": pa.array([times[k]] * len(y), pa.timestamp("us")), "lat": pa.array(y), "lon": pa.array(x)}
                for n in values:
                    v = header.variables[n]
                    if v.dims[1:] == (lat_name, lon_name):
                        got = read_part(file, header, n, k, rows)
                    else:  # stored by longitude
                        got = read_part(file, header, n, k).T[rows[0] : rows[1]]
                    got = cleaned(np.ascontiguousarray(got), v).ravel()
                    columns[n] = pa.array(got, mask=np.isnan(got))
                yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)


class CubeSource(DataSource):
    """Format netcdf3. Options: path; variables (all of time, latitude and longitude by default); time_name, lat_name, lon_name; lat_min, lat_max, both
    included; slab, the steps of a partition."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        paths = paths_of(self.options["path"])
        if not paths:
            raise FileNotFoundError(self.options["path"])
        with _open(paths[0]) as file:
            header = read_header(file)
        axes = [self.options.get(f"{a}_name", a) for a in ("time", "lat", "lon")]
        lacking = [a for a in axes if a not in header.variables]
        if lacking:
            raise ValueError(f"the file has no {', '.join(lacking)}")
        cubes = [n for n, v in header.variables.items() if len(v.dims) == 3 and v.dims[0] == axes[0] and set(v.dims[1:]) == set(axes[1:]) and v.kind != "S1"]
        asked = [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()] or cubes
        if set(asked) - set(cubes):
            raise ValueError(f"the file has no cubes {', '.join(sorted(set(asked) - set(cubes)))}")
        return "time timestamp_ntz, lat double, lon double" + "".join(f", `{n}` double" for n in asked)

    def reader(self, schema: Any) -> CubeReader:
        return CubeReader(dict(self.options), schema)


def read_cube(spark: SparkSession, path: str, lat_min: float | None = -60.0, lat_max: float | None = 60.0, variables: Sequence[str] = (), **options: str) -> DataFrame:
    """Cubes of NetCDF classic files, one below the other along time: time, lat, lon and a column for each variable; missing values are null.

    Latitudes between both ends are read alone. Filters on lat and time reach the reader where the session has
    `spark.sql.python.filterPushdown.enabled`.
    """
    spark.dataSource.register(CubeSource)
    reader = spark.read.format("netcdf3").option("path", path).options(**options)
    for key, value in (("lat_min", lat_min), ("lat_max", lat_max)):
        reader = reader if value is None else reader.option(key, str(value))
    return (reader.option("variables", ",".join(variables)) if variables else reader).load()


def read_rain(spark: SparkSession, path: str, variable: str, least: float = 0.1, **options: str) -> DataFrame:
    """Rain rates of raster files, stored either way round: values below `least` are missing."""
    cube = read_cube(spark, path, None, None, (variable,), **options)
    return cube.withColumn(variable, F.when(F.col(variable) >= least, F.col(variable)))
