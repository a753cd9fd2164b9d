"""Work on maps by tiles: cells are dealt once, to their tile and as a halo to tiles nearby, and a task has one tile as an array.

Cells are rows (keys of the map, i, j, ...), i and j being indices along the axes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import _same

#: Cells along a tile's side.
TILE = 256
SOUTH, EAST, NORTH, WEST = 1, 2, 4, 8


def dealt(cells: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """cells with `ti` and `tj`, a row for each tile that the cell is in or at most `reach` away from."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    return cells.withColumn("ti", span("i")).withColumn("tj", span("j"))


def _place(table: pa.Table, reach: int, tile: int) -> tuple[np.ndarray, ...]:
    """Rows and columns in a tile with its halo, and the tile's first row and column."""
    first = [table.column(c)[0].as_py() * tile for c in ("ti", "tj")]
    return (*(table.column(c).to_numpy() - f + reach for c, f in zip("ij", first, strict=True)), *first)


def convolved(cells: DataFrame, kernel: list[float], value: str = "v", keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """keys, i, j and `value`: the cells' values spread along both axes by the kernel (of odd length), at every index that a cell reaches.

    One shuffle; a task has a tile and its halo.
    """
    reach, weights = len(kernel) // 2, np.array(kernel)
    side = tile + 2 * reach
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def spread(grid: np.ndarray, w: np.ndarray) -> np.ndarray:
        down = sum(x * grid[k : k + tile] for k, x in enumerate(w))
        return sum(x * down[:, k : k + tile] for k, x in enumerate(w))

    def run(table: pa.Table) -> pa.Table:
        i, j, top, left = _place(table, reach, tile)
        grid, some = np.zeros((side, side)), np.zeros((side, side))
        np.add.at(grid, (i, j), table.column(value).to_numpy())
        some[i, j] = 1
        a, b = np.nonzero(spread(some, np.ones(len(weights))))
        out = spread(grid, weights)[a, b]
        return pa.table({**{k: pa.chunked_array([pa.array([table.column(k)[0].as_py()] * len(a), table.schema.field(k).type)]) for k in keys}, "i": a + top, "j": b + left, value: out})

    rows = dealt(cells.select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), F.col(value).cast("double").alias(value)), reach, tile)
    return rows.groupBy(*keys, "ti", "tj").applyInArrow(run, f"{kinds}{', ' if kinds else ''}i long, j long, {value} double")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n points' component, given links a-b: roots are hung under lesser ones, then paths are cut short."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def labelled(cells: DataFrame, keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """cells (keys, i, j) with `part`, the code of the first cell (by row, then column) of the cell's connected part of its tile, and `open`, the sides
    without a neighbour. Cells meet by their sides. A cell's code is its row shifted by 32 bits, and its column."""
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    side = tile + 2

    def run(table: pa.Table) -> pa.Table:
        i, j, top, left = _place(table, 1, tile)
        filled = np.zeros((side, side), bool)
        filled[i, j] = True
        own = filled[1:-1, 1:-1]
        number = np.full(own.shape, -1)
        a, b = np.nonzero(own)
        number[a, b] = np.arange(len(a))  # by row, then column, so the least number is the first cell
        pairs = [(number[:-1], number[1:]), (number[:, :-1], number[:, 1:])]
        links = [np.stack([p[(p >= 0) & (q >= 0)], q[(p >= 0) & (q >= 0)]]) for p, q in pairs]
        label = _labels(len(a), *np.concatenate(links, axis=1))
        code = (a + top) << 32 | (b + left)
        bare = ~filled
        sides = bare[:-2, 1:-1] * SOUTH + bare[1:-1, 2:] * EAST + bare[2:, 1:-1] * NORTH + bare[1:-1, :-2] * WEST
        return pa.table({**{k: pa.chunked_array([pa.array([table.column(k)[0].as_py()] * len(a), table.schema.field(k).type)]) for k in keys}, "i": a + top, "j": b + left, "part": code[label], "open": sides[a, b].astype(np.int32)})

    rows = dealt(cells.select(*keys, F.col("i").cast("long"), F.col("j").cast("long")), 1, tile)
    return rows.groupBy(*keys, "ti", "tj").applyInArrow(run, f"{kinds}{', ' if kinds else ''}i long, j long, part long, open int")


def _edge_sum(edges: DataFrame, keys: list[str]) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())


def least_members(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, u, v -> keys, u, root for every u that isn't its component's least member, by star contraction: in turns, each
    node's greater neighbours are hung on the least of all its neighbours, then its lesser ones are. Rounds grow with the logarithm of the nodes."""
    by = list(keys)
    edges = durable(links.filter("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _edge_sum(edges, by)
    while True:
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _same(both, least, [*by, "u"]).filter("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _same(down, down.groupBy(*by, "u").agg(F.min("v").alias("m")), [*by, "u"])
        hung = small.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(*by, "u", F.col("m").alias("v")))
        edges = durable(hung.filter("u <> v").distinct())
        after = _edge_sum(edges, by)
        if after == before:
            return edges.withColumnRenamed("v", "root")
        before = after


def connected(cells: DataFrame, keys: tuple[str, ...] = (), tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """`labelled` cells, and for each part its area's root (keys, part, root): parts meet where cells of two tiles share a side."""
    by = list(keys)
    rows = labelled(cells, keys, tile)
    rows = durable(rows)  # read three times
    links = None
    for axis in "ij":
        other = "j" if axis == "i" else "i"
        low = rows.filter((F.col(axis) + 1) % tile == 0).select(*by, (F.col(axis) + 1).alias(axis), other, F.col("part").alias("u"))
        high = rows.filter(F.col(axis) % tile == 0).select(*by, axis, other, F.col("part").alias("v"))
        met = _same(low, high, [*by, "i", "j"]).select(*by, "u", "v")
        links = met if links is None else links.unionByName(met)
    roots = least_members(links, keys).withColumnRenamed("u", "part")
    parts = rows.select(*by, "part").distinct()
    found = _same(parts, roots, [*by, "part"], "left")
    return rows, found.select(*by, "part", F.coalesce("root", "part").alias("root"))


def outline(i: np.ndarray, j: np.ndarray, sides: np.ndarray, south: np.ndarray, north: np.ndarray, west: np.ndarray, east: np.ndarray) -> str:
    """WKT of an area from its cells' bare sides and bounds: sides are walked with the area on the left, turning right where four meet, so that
    no ring comes to a corner twice; the ring that runs counter-clockwise is the shell."""
    lat, lon = dict(zip(i.tolist(), south.tolist(), strict=True)), dict(zip(j.tolist(), west.tolist(), strict=True))
    lat |= dict(zip((i + 1).tolist(), north.tolist(), strict=True))
    lon |= dict(zip((j + 1).tolist(), east.tolist(), strict=True))
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for bit, a, step in ((SOUTH, (0, 0), (1, 0)), (EAST, (1, 0), (0, 1)), (NORTH, (1, 1), (-1, 0)), (WEST, (0, 1), (0, -1))):
        on = (sides & bit) > 0
        for x, y in zip((j[on] + a[0]).tolist(), (i[on] + a[1]).tolist(), strict=True):
            ahead.setdefault((x, y), []).append(step)
    rings = []
    while ahead:
        start = min(ahead)
        at, step, ring = start, None, []
        while at in ahead:
            ways = ahead[at]
            pick = ways[0] if len(ways) == 1 or step is None else (step[1], -step[0])
            ways.remove(pick)
            if not ways:
                del ahead[at]
            if pick != step:
                ring.append(at)
            step, at = pick, (at[0] + pick[0], at[1] + pick[1])
            if at == start and (at not in ahead or (step[1], -step[0]) not in ahead[at]):
                break
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        rings.append((twice < 0, ring))
    text = lambda ring: "(" + ", ".join(f"{lon[x]!r} {lat[y]!r}" for x, y in [*ring, ring[0]]) + ")"
    return f"POLYGON ({', '.join(text(r) for _, r in sorted(rings, key=lambda r: r[0]))})"


def outlines(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, root, i, j, open, lat_low, lat_high, lon_low, lon_high of cells with a bare side -> keys, root, outline. An area's cells with bare
    sides meet in one task, as its text does."""
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in (*keys, "root"))

    def run(table: pa.Table) -> pa.Table:
        text = outline(*(table.column(c).to_numpy() for c in ("i", "j", "open", "lat_low", "lat_high", "lon_low", "lon_high")))
        return pa.table({**{k: pa.chunked_array([pa.array([table.column(k)[0].as_py()], table.schema.field(k).type)]) for k in (*keys, "root")}, "outline": [text]})

    return cells.groupBy(*keys, "root").applyInArrow(run, f"{kinds}, outline string")
