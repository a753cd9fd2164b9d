"""Points in a table of regions: regions are covered by grid cells, points meet them by cell, and only points in a cell with a
boundary are tested, against that cell's edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Ring, sides, unnested
from ..session import stored

#: Sizes of cells are 2 ** level degrees.
LEVELS = range(-7, 9)
#: Edges that a cell with a boundary has on average, and cells that a region's bounds have at most.
EDGES, CELLS = 8, 1 << 14
#: Where in its cell a reference point may lie; the one farthest from any edge is taken.
PLACES = np.array([(0.5, 0.5), (0.37, 0.61), (0.71, 0.29), (0.23, 0.83), (0.89, 0.13), (0.11, 0.17), (0.93, 0.91), (0.47, 0.07)])
#: Rows and edges of a cover up to which it is broadcast.
ROWS, TESTED = 20_000, 100_000
#: Places of one key up to which they are compared in pairs.
PAIRED = 16
_EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def level_of(rings: list[Ring]) -> int:
    """Large enough for about EDGES edges in a cell that has any, and for CELLS cells in the bounds."""
    size = np.concatenate(rings)
    wide, high = size.max(0) - size.min(0)
    length = sum(float(np.hypot(*np.diff(r, axis=0).T).sum()) for r in rings) / max(1, sum(len(r) - 1 for r in rings))
    least = max(EDGES * length, math.sqrt(max(wide * high, 1e-12) / CELLS), max(wide, high) / CELLS, 2.0 ** LEVELS[0])
    return min(max(math.ceil(math.log2(least)), LEVELS[0]), LEVELS[-1])


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the index of each, repeated, and 0, 1, ... within it."""
    at = np.repeat(np.arange(len(size)), size)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)


def _distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(*(p - a - d * t[:, None]).T)


def lines_of(rings: list[Ring], size: float) -> tuple[np.ndarray, ...]:
    """Of one part, cells with a boundary: columns, rows, reference points (n, 2), whether these are inside, where their edges begin and end,
    and the edges (m, 4) of one cell after those of another; then runs of whole cells: (row, first column, the column after the last)."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    slack = 1e-9
    low, high = np.floor(np.minimum(a, b)[:, 1] / size - slack).astype(int), np.floor(np.maximum(a, b)[:, 1] / size + slack).astype(int)
    edge, nth = spread(high - low + 1)
    row = low[edge] + nth
    # The part of the edge that is in the row's band, from one side to the other.
    p, q = a[edge], b[edge]
    rise = q[:, 1] - p[:, 1]
    safe = np.where(rise == 0, 1.0, rise)
    cut = [np.where(rise == 0, end, np.clip((y * size - p[:, 1]) / safe, 0, 1)) for y, end in ((row, 0.0), (row + 1, 1.0))]
    xs = [p[:, 0] + (q[:, 0] - p[:, 0]) * t for t in cut]
    left, right = np.floor(np.minimum(*xs) / size - slack).astype(int), np.floor(np.maximum(*xs) / size + slack).astype(int)
    bands = row, edge
    at, nth = spread(right - left + 1)
    column, line, edge = left[at] + nth, row[at], edge[at]
    order = np.lexsort((edge, column, line))
    column, line, edge = column[order], line[order], edge[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(column) != 0) | (np.diff(line) != 0)]))
    ends = np.concatenate([first[1:], [len(edge)]])
    cell = np.repeat(np.arange(len(first)), ends - first)
    corner = np.column_stack([column[first], line[first]]) * size
    away = np.array([np.minimum.reduceat(_distance(corner[cell] + size * place, a[edge], b[edge]), first) for place in PLACES])
    reference = corner + size * PLACES[away.argmax(0)]
    columns, rows = column[first], line[first]
    within = inside_bands(a, b, *bands, reference, rows)
    gaps = np.flatnonzero((np.diff(columns) > 1) & (np.diff(rows) == 0))
    middle = np.column_stack([(columns[gaps] + 1.5) * size, (rows[gaps] + 0.5) * size])
    gaps = gaps[inside_bands(a, b, *bands, middle, rows[gaps])]
    runs = list(zip(rows[gaps].tolist(), (columns[gaps] + 1).tolist(), columns[gaps + 1].tolist(), strict=True))
    return columns, rows, reference, within, first, ends, np.column_stack([a[edge], b[edge]]), runs


def cells_of(rings: list[Ring], size: float) -> Iterator[tuple]:
    """Of one part: (column, row, whole, reference x, y, whether that is inside, edges (n, 4)) of every cell that isn't outside."""
    columns, rows, reference, within, first, ends, edges, runs = lines_of(rings, size)
    for k in range(len(columns)):
        yield int(columns[k]), int(rows[k]), False, *map(float, reference[k]), bool(within[k]), edges[first[k] : ends[k]]
    for j, start, stop in runs:
        for i in range(start, stop):
            yield int(i), int(j), True, 0.0, 0.0, True, np.zeros((0, 4))


def closed_of(parts: list[list[Ring]] | None) -> list[list[Ring]]:
    """Parts with their rings closed, without rings of fewer than three points."""
    closed = [[r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]) for r in part if len(r) > 2] for part in parts or []]
    return [part for part in closed if part]


def inside_bands(a: np.ndarray, b: np.ndarray, row: np.ndarray, edge: np.ndarray, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether points of rows of cells are inside, by the edges that reach into a point's row: `edge` has those of `row`."""
    order = np.argsort(row, kind="stable")
    edge = edge[order]
    start, end = (np.searchsorted(row[order], rows, side) for side in ("left", "right"))
    out = np.zeros(len(points), bool)
    # About a million pairs of a point and an edge at once.
    block = np.cumsum(end - start) >> 20
    for at in np.split(np.arange(len(points)), np.flatnonzero(np.diff(block)) + 1):
        test, nth = spread(end[at] - start[at])
        p, q = a[own := edge[start[at][test] + nth]], b[own]
        x, y = points[at, 0][test], points[at, 1][test]
        spans = (p[:, 1] > y) != (q[:, 1] > y)
        side = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0])
        out[at] = np.bincount(test[spans & np.where(q[:, 1] > p[:, 1], side < 0, side > 0)], minlength=len(at)) % 2 == 1
    return out


def cover(regions: DataFrame, id_col: str = "region", parts_col: str = "parts") -> DataFrame:
    """A row for each region and cell that it reaches: region, level, ci, cj, whole (the cell is inside), and what a test needs of each
    part that has edges there. `parts_col` is a column of PARTS (functions.geometry); rows without geometry have no cells, and rows of one id are
    parts of one region. It is written as a table in the shared folder, as it is read several times."""
    kind = regions.schema[id_col].dataType.simpleString()
    names = ["region", "level", "ci", "cj", "whole", "x", "y", "within", "edges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parts in enumerate(unnested(batch.column(1))):
                closed = closed_of(parts)
                if not closed:
                    continue
                level = level_of([r for part in closed for r in part])
                cells = [c for part in closed for c in cells_of(part, 2.0**level)]
                if not cells:
                    continue
                columns = list(zip(*cells, strict=True))
                flat = np.concatenate(columns[6])
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in columns[6]])]).astype(np.int32)
                edges = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, n].copy()) for n in range(4)], ["ax", "ay", "bx", "by"]))
                ids = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(cells))
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
                whole = pa.RecordBatch.from_arrays([ids, pa.array([level] * len(cells), pa.int32()), *(pa.array(c, t) for c, t in zip(columns[:6], types, strict=True)), edges], names)
                yield from (whole.slice(n, 4096) for n in range(0, len(whole), 4096))

    rows = regions.select(F.col(id_col).alias("region"), F.col(parts_col).alias("parts")).mapInArrow(run, f"region {kind}, level int, ci long, cj long, whole boolean, x double, y double, within boolean, edges array<{_EDGE}>")
    test = F.struct("x", "y", "within", "edges")
    return stored(rows.groupBy("region", "level", "ci", "cj").agg(F.max("whole").alias("whole"), F.collect_list(F.when(~F.col("whole"), test)).alias("tests")))


def tested(test: np.ndarray, within: np.ndarray, edges: np.ndarray, left: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For tests, by the edges (ax, ay, bx, by) of each (`test` is an edge's), whether the reference point is `left` of an edge, points p and
    reference points r, which are `within` or not: whether the point is on an edge, or inside."""
    own = sides(*edges, *(c[test] for c in p))
    out = np.zeros(len(within), bool)
    k = np.flatnonzero(own == 0)
    (ax, ay, bx, by), (px, py) = (c[k] for c in edges), (c[test[k]] for c in p)
    out[test[k[(px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))]]] = True
    # Only edges whose line is between the points can be crossed.
    k = np.flatnonzero((own > 0) != left)
    (ax, ay, bx, by), (px, py), (rx, ry) = (c[k] for c in edges), (c[test[k]] for c in p), (c[test[k]] for c in r)
    between = (sides(px, py, rx, ry, ax, ay) >= 0) != (sides(px, py, rx, ry, bx, by) >= 0)
    return out | ((np.bincount(test[k[between]], minlength=len(within)) % 2 == 1) != within)


def _hit(x: Column, y: Column, tests: Column) -> Column:
    """On an edge of a test, or with an odd number of its edges between the point and a reference point outside, an even one inside."""
    @F.arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array, tests: pa.Array) -> pa.Array:
        number = lambda c: c.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tests)), number(pc.fill_null(pc.list_value_length(tests), 0)))
        flat = pc.list_flatten(tests)
        test = np.repeat(np.arange(len(flat)), number(pc.list_value_length(flat.field("edges"))))
        edges = pc.list_flatten(flat.field("edges"))
        sides_of, reference = [number(edges.field(k)) for k in range(4)], [number(flat.field(k)) for k in range(2)]
        left = sides(*sides_of, *(c[test] for c in reference)) > 0
        hit = tested(test, number(flat.field("within")).astype(bool), sides_of, left, [number(x)[row], number(y)[row]], reference)
        return pa.array(np.bincount(row[hit], minlength=len(tests)) > 0)

    return run(x, y, tests)


def _places(lon: Column, lat: Column, levels: list[int]) -> Column:
    """The cells of a point, one for each level."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(lon / 2.0**k).alias("ci"), F.floor(lat / 2.0**k).alias("cj")) for k in levels])


def _used(cells: DataFrame) -> tuple[list[int], bool]:
    """Levels of cells, and whether there are few enough of them to be broadcast."""
    used = cells.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("tests", F.lit(0), lambda n, t: n + F.size(t["edges"]))).alias("edges")).collect()
    return sorted(r.level for r in used) or [0], sum(r.n for r in used) <= ROWS and sum(r.edges for r in used) <= TESTED


def _joined(points: DataFrame, cells: DataFrame, lon: str, lat: str, bounds: DataFrame | None = None) -> DataFrame:
    """points with tests and region of `cells`, and what `bounds` has of that region, prefixed by __, for every row of their cell.

    The optimizer knows nothing of how many cells a region has, so what is broadcast is decided by the rows and edges that there are.
    """
    levels, small = _used(cells)
    near = cells.select("level", "ci", "cj", "whole", "tests", "region")
    near = near if bounds is None else near.join(bounds, "region")
    near = near.select(*[F.col(c).alias(f"__{c}") for c in near.columns])
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    places = _places(x, y, levels)
    dealt = points.filter(x.isNotNull() & ~F.isnan(x) & y.isNotNull() & ~F.isnan(y)).withColumn("__cell", F.explode(places))
    on = reduce(lambda p, q: p & q, [F.col(f"__cell.{c}") == F.col(f"__{c}") for c in ("level", "ci", "cj")])
    return dealt.join(near.hint("broadcast" if small else "merge"), on)


def _met(cells: DataFrame, lon: str, lat: str, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `join` gives of whole cells, and of the others where the point is inside. Only rows of the others pass through Python, unless
    there are few cells: then points are read once."""
    hit = _hit(F.col(lon).cast("double"), F.col(lat).cast("double"), F.col("__tests"))
    if _used(cells)[1]:
        return join(cells).filter(F.col("__whole") | hit).drop("__whole", "__tests")
    return join(cells.filter("whole")).drop("__whole", "__tests").unionAll(join(cells.filter("not whole")).filter(hit).drop("__whole", "__tests"))


def in_regions(points: DataFrame, cells: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points joined with `region`, a row for each region that a point is in or on the boundary of; points without coordinates are in none.

    An equi-join on the cell: `cells` is `cover`'s result. Levels in use, a dozen numbers at most, come to the driver first.
    """
    return _met(cells, lon, lat, lambda c: _joined(points, c, lon, lat)).select(*points.columns, F.col("__region").alias("region"))


def counts_in_regions(points: DataFrame, cells: DataFrame, key: str = "uid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """region, n (rows of points in it), n_keys (distinct keys of these), of regions with a point; the same as `in_regions` and an
    aggregate, without a row for each point and region.

    A place is tested once, with the counts of its rows and of its keys. A key with several places in a region is counted
    too often by that, so what is taken off are places with an earlier one of the same key in the same region; only places closer to each other
    than the largest region is wide can be such. Keys of more than PAIRED places are met with each region instead.
    """
    rows = points.select(F.col(key).alias("key"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).filter("x is not null and y is not null")
    places = rows.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy("key")
    known = places.filter("key is not null").select("*", F.count(F.lit(1)).over(of).alias("c"), F.row_number().over(of.orderBy("x", "y")).alias("r"))
    few = known.filter(F.col("c") <= PAIRED)
    weights = known.select("x", "y", "n", (F.col("c") <= PAIRED).cast("long").alias("u")).unionAll(places.filter("key is null").select("x", "y", "n", F.lit(0).cast("long").alias("u")))
    weights = weights.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    zero = F.lit(0).cast("long")
    counts = _met(cells, "x", "y", lambda c: _joined(weights, c, "x", "y")).groupBy(F.col("__region").alias("region")).agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    many = in_regions(known.filter(F.col("c") > PAIRED).select("key", "x", "y"), cells, "x", "y").select("region", "key").distinct().groupBy("region").agg(zero.alias("n"), F.count(F.lit(1)).alias("u"))

    size = F.pow(F.lit(2.0), F.col("level"))
    ends = [F.min(F.col("ci") * size).alias("x0"), F.max((F.col("ci") + 1) * size).alias("x1"), F.min(F.col("cj") * size).alias("y0"), F.max((F.col("cj") + 1) * size).alias("y1")]
    bounds = cells.groupBy("region").agg(*ends)
    widest = bounds.agg(F.max(F.col("x1") - F.col("x0")).alias("x"), F.max(F.col("y1") - F.col("y0")).alias("y")).first()
    if widest.x is None:
        return counts.select("region", "n", F.col("u").alias("n_keys"))
    several = few.filter("c > 1").select("key", "r", "x", "y")
    before = several.select(F.col("key").alias("pkey"), F.col("r").alias("pr"), F.col("x").alias("px"), F.col("y").alias("py"))
    close = (F.col("pr") < F.col("r")) & (F.abs(F.col("px") - F.col("x")) <= widest.x) & (F.abs(F.col("py") - F.col("y")) <= widest.y)
    pairs = several.join(before, (F.col("key") == F.col("pkey")) & close).drop("pkey", "pr")
    reached = F.col("px").between(F.col("__x0"), F.col("__x1")) & F.col("py").between(F.col("__y0"), F.col("__y1"))
    first = _met(cells, "x", "y", lambda c: _joined(pairs, c, "x", "y", bounds).filter(reached)).select("key", "r", "px", "py", F.col("__region").alias("of"))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    dealt = first.withColumn("__cell", F.explode(_places(F.col("px"), F.col("py"), levels)))
    on = reduce(lambda p, q: p & q, [F.col("of") == F.col("__region"), *(F.col(f"__cell.{c}") == F.col(f"__{c}") for c in ("level", "ci", "cj"))])
    both = _met(cells, "px", "py", lambda c: dealt.join(c.select(*[F.col(k).alias(f"__{k}") for k in ("level", "ci", "cj", "whole", "tests", "region")]).hint("merge"), on))
    again = both.select("of", "key", "r").distinct().groupBy(F.col("of").alias("region")).agg(zero.alias("n"), (-F.count(F.lit(1))).alias("u"))
    return counts.unionAll(many).unionAll(again).groupBy("region").agg(F.sum("n").alias("n"), F.sum("u").alias("n_keys"))
