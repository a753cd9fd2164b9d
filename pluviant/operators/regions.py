"""Spatial selection: systems and cells in a region of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_in_polygon, rings_literal
from ..functions.geometry import PARTS
from ..session import stored
from .cover import cover, in_regions
from .motion import start_end, with_valid_centroids

Rings = list[list[tuple[float, float]]]
#: One polygon, or the parts of a region, which may overlap.
Region = Rings | list[Rings]
#: Points of a region up to which a plan holds them as literals; a region of more is covered by cells.
LITERALS = 64


def parts_of(region: Region) -> list[Rings]:
    return region if isinstance(region[0][0], list) else [region]


def _bounds(rings: Rings) -> tuple[float, float, float, float]:
    xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
    return min(xs), min(ys), max(xs), max(ys)


def clip(df: DataFrame, region: Region, srid: int = 4326, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose point (a cell's centre, a centroid) is in the region: bounds on plain columns first, then the polygon."""
    if srid != 4326:
        raise ValueError("the region must be in EPSG:4326")
    parts = parts_of(region)
    x0, y0, x1, y1 = _bounds([r for part in parts for r in part])
    near = df.filter(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))
    if sum(len(r) for part in parts for r in part) > LITERALS:
        table = df.sparkSession.createDataFrame([(0, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts])], f"region int, parts {PARTS}")
        return in_regions(near, cover(table), lon, lat).select(*df.columns)
    inside = F.lit(False)
    for rings in parts:
        inside = inside | point_in_polygon(lon, lat, rings_literal(rings))
    return near.filter(inside)


def _placed(tracks: DataFrame, geometry: str) -> DataFrame:
    """What `start_end` needs of rows with a valid polygon, written once: it is read to find systems and for their ends."""
    path = [c for c in ("trajectory",) if c in tracks.columns]
    return stored(with_valid_centroids(tracks, geometry).select("uid", "cindex", "timestamp", "lon", "lat", *path))


def tracks_of_regions(tracks: DataFrame, regions: DataFrame, id_col: str = "region", parts_col: str = "parts", geometry: str | None = None) -> DataFrame:
    """For a table of regions: region, and start, end and distance of the whole track of every system that is ever in it.

    With `geometry`, a column of WKT, a row's place is its geometry's centroid, and rows whose polygon isn't valid don't count.
    """
    rows = tracks if geometry is None else _placed(tracks, geometry)
    met = in_regions(rows.select("uid", "lon", "lat"), cover(regions, id_col, parts_col)).select("uid", "region").distinct()
    ends = start_end(rows, met.select("uid").distinct())
    return met.join(ends, "uid")


def region_tracks(tracks: DataFrame, region: Region, srid: int = 4326, geometry: str | None = None) -> DataFrame:
    """Start, end and distance of the whole track of every system that is ever in the region. With `geometry`, a column of WKT, places are
    centroids, and rows whose polygon isn't valid don't count."""
    tracks = tracks if geometry is None else _placed(tracks, geometry)
    return start_end(tracks, clip(tracks, region, srid).select("uid").distinct())


def tropics(df: DataFrame, outside: bool = False, lat: str = "lat") -> DataFrame:
    """Latitudes up to 23.5 degrees on either side, or all others."""
    inside = F.abs(F.col(lat)) <= 23.5
    return df.filter(~inside if outside else inside)
