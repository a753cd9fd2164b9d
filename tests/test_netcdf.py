"""NetCDF classic files, written here, through the data source."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.sources import netcdf

CODES = {"i1": 1, "S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}


def write(path, dims, variables, version=1, records=0):
    """dims: (name, size), 0 for the unlimited one; variables: name -> (dims, array, attributes)."""
    wide = version == 5
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    text = lambda s: count(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    names = [d for d, _ in dims]

    def attributes(found):
        out = struct.pack(">i", 12 if found else 0) + count(len(found))
        for key, value in found.items():
            raw = value.encode() if isinstance(value, str) else value.tobytes()
            code, n = (2, len(raw)) if isinstance(value, str) else (CODES[value.dtype.str.replace("|", "")], value.size)
            out += text(key) + struct.pack(">i", code) + count(n) + raw + b"\0" * (-len(raw) % 4)
        return out

    by_record = [n for n, (of, _, _) in variables.items() if of and dict(dims)[of[0]] == 0]
    size = {n: (a[0].nbytes if n in by_record else a.nbytes) for n, (_, a, _) in variables.items()}
    padded = {n: s if by_record == [n] else s + -s % 4 for n, s in size.items()}

    def header(begins):
        out = b"CDF" + bytes([version]) + count(records)
        out += struct.pack(">i", 10) + count(len(dims)) + b"".join(text(d) + count(n) for d, n in dims) + attributes({"title": "made by a test"})
        out += struct.pack(">i", 11) + count(len(variables))
        for n, (of, a, extra) in variables.items():
            out += text(n) + count(len(of)) + b"".join(count(names.index(d)) for d in of) + attributes(extra)
            out += struct.pack(">i", CODES[a.dtype.str.replace("|", "")]) + count(size[n] + -size[n] % 4) + struct.pack(">i" if version == 1 else ">q", begins[n])
        return out

    at, begins = len(header(dict.fromkeys(variables, 0))), {}
    for n in [v for v in variables if v not in by_record] + by_record:
        begins[n], at = at, at + padded[n]
    body = b"".join(variables[n][1].tobytes() + b"\0" * (-size[n] % 4) for n in variables if n not in by_record)
    for k in range(records):
        body += b"".join(variables[n][1][k : k + 1].tobytes() + b"\0" * (padded[n] - size[n]) for n in by_record)
    path.write_bytes(header(begins) + body)


LAT, LON, START = np.arange(-75.0, 76.0, 10.0), np.arange(-175.0, 176.0, 50.0), datetime(2015, 3, 1)


def cube(path, first, steps, version=1, records=False, turned=False):
    rng = np.random.default_rng(first)
    rain = rng.random((steps, len(LAT), len(LON))).astype(">f4")
    rain[0, 0, 0], rain[0, 5, 1] = np.nan, -999
    packed = rng.integers(0, 1000, rain.shape).astype(">i2")
    packed[0, 6, 2] = -1
    order, at = (("time", "lon", "lat"), (0, 2, 1)) if turned else (("time", "lat", "lon"), (0, 1, 2))
    variables = {
        "time": (("time",), (first + np.arange(steps)).astype(">i4"), {"units": "hours since 2015-03-01 00:00:00"}),
        "lat": (("lat",), LAT.astype(">f4"), {}), "lon": (("lon",), LON.astype(">f8"), {}),
        "rain": (order, np.ascontiguousarray(rain.transpose(at)), {"_FillValue": np.array([-999], ">f4")}),
        "packed": (order, np.ascontiguousarray(packed.transpose(at)), {"_FillValue": np.array([-1], ">i2"), "scale_factor": np.array([0.5], ">f8"), "add_offset": np.array([10.0], ">f8")}),
        "flag": (("time",), np.ones(steps, ">i2"), {}),
    }
    write(path, [("time", 0 if records else steps), ("lat", len(LAT)), ("lon", len(LON))], variables, version, steps if records else 0)
    want = {}
    for (k, i, j), v in np.ndenumerate(rain):
        p = packed[k, i, j]
        want[START + timedelta(hours=first + k), float(LAT[i]), float(LON[j])] = (None if np.isnan(v) or v == -999 else float(v), None if p == -1 else p * 0.5 + 10)
    return want


@pytest.mark.parametrize("version, records, turned", [(1, False, False), (1, True, False), (2, True, True), (5, True, False), (5, False, True)])
def test_cubes_are_read_whole(spark, tmp_path, version, records, turned):
    want = cube(tmp_path / "a.nc", 0, 5, version, records, turned) | cube(tmp_path / "b.nc", 5, 3, version, records, turned)
    df = netcdf.read_cube(spark, f"{tmp_path}/*.nc", None, None, slab="2")
    assert df.columns == ["time", "lat", "lon", "rain", "packed"] and df.dtypes[0] == ("time", "timestamp_ntz")
    assert {(r.time, r.lat, r.lon): (r.rain, r.packed) for r in df.collect()} == want and df.rdd.getNumPartitions() == 5


def test_bounds_reach_the_reader(spark, tmp_path, monkeypatch):
    want = cube(tmp_path / "a.nc", 0, 48, records=True)
    path = f"file://{tmp_path}/a.nc"
    df = netcdf.read_cube(spark, path, slab="12").filter((F.col("time") >= F.lit("2015-03-02 06:00:00").cast("timestamp_ntz")) & (F.col("lat") > 0))
    assert {(r.time, r.lat, r.lon): (r.rain, r.packed) for r in df.collect()} == {k: v for k, v in want.items() if k[0] >= datetime(2015, 3, 2, 6) and 0 < k[1] <= 60}
    reader = netcdf.CubeReader({"path": path, "slab": "12", "lat_min": "-60", "lat_max": "60"}, df.schema)
    list(reader.pushFilters([netcdf.GreaterThanOrEqual(("time",), datetime(2015, 3, 2, 6)), netcdf.GreaterThan(("lat",), 0.0)]))
    slabs = reader.partitions()
    assert [(s.first, s.last) for s in slabs] == [(24, 36), (36, 48)]
    asked = []
    real = netcdf.read_part
    monkeypatch.setattr(netcdf, "read_part", lambda f, h, n, k=None, rows=None: asked.append((n, k, rows)) or real(f, h, n, k, rows))
    assert sum(len(b) for b in reader.read(slabs[0])) == 6 * 6 * len(LON)  # six steps of twelve, six latitudes of sixteen
    assert {a for a in asked if a[0] == "rain"} == {("rain", k, (8, 14)) for k in range(30, 36)}


def test_variables_names_and_errors(spark, tmp_path):
    cube(tmp_path / "a.nc", 0, 2)
    assert netcdf.read_cube(spark, str(tmp_path / "a.nc"), variables=["packed"]).columns == ["time", "lat", "lon", "packed"]
    rain = netcdf.read_rain(spark, str(tmp_path), "rain", 0.5)
    assert rain.filter("rain < 0.5").count() == 0 and rain.filter("rain is null").count() > 0
    (tmp_path / "b.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 64)
    (tmp_path / "c.nc").write_bytes(b"GIF89a")
    for name, text in (("b.nc", "HDF5"), ("c.nc", "classic"), ("d.nc", "d.nc")):
        with pytest.raises(Exception, match=text):
            netcdf.read_cube(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="no cubes snow"):
        netcdf.read_cube(spark, str(tmp_path / "a.nc"), variables=["snow"]).collect()
    with pytest.raises(ValueError, match="fortnights"):
        netcdf.times_of(np.arange(2), "fortnights since 2000-01-01")
    assert netcdf.times_of(np.array([0.5]), "days since 1990-1-1")[0] == datetime(1990, 1, 1, 12)
    assert netcdf.read_cube(spark, str(tmp_path / "a.nc"), 61.0, 64.0).count() == 0
