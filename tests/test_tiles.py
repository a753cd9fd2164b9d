"""Maps by tiles against whole maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.functions import geometry as G
from pluviant.operators import grid, tiles


def whole_map_areas(mask):
    """First cell and size of each 4-connected area, by flooding."""
    left, out = {tuple(c) for c in np.argwhere(mask).tolist()}, []
    while left:
        first = min(left)
        left.discard(first)
        stack, cells = [first], [first]
        while stack:
            a, b = stack.pop()
            for near in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if near in left:
                    left.discard(near)
                    stack.append(near)
                    cells.append(near)
        out.append((first, len(cells)))
    return sorted(out)


def snake(n):
    """One area that winds through the whole map."""
    mask = np.zeros((n, n), bool)
    mask[::2] = True
    for k, row in enumerate(range(1, n - 1, 2)):
        mask[row, -1 if k % 2 == 0 else 0] = True
    return mask


MASKS = {"noise": np.random.default_rng(0).random((23, 31)) < 0.55, "full": np.ones((9, 14), bool), "chess": (np.indices((11, 11)).sum(0) % 2).astype(bool), "snake": snake(25), "one": np.eye(1, dtype=bool), "rings": np.pad(np.pad(np.ones((5, 5), bool), 2), 3, constant_values=True)}


@pytest.mark.parametrize("tile", [4, 256])
def test_areas_are_those_of_whole_maps(spark, tile):
    rows = [(name, int(i), int(j)) for name, mask in MASKS.items() for i, j in np.argwhere(mask)]
    cells = spark.createDataFrame(rows + [(None, 3, 3)], "map string, i int, j int").repartition(5)
    labelled, roots = tiles.connected(cells, ("map",), tile)
    both = labelled.alias("l").join(roots.alias("r"), F.col("l.map").eqNullSafe(F.col("r.map")) & (F.col("l.part") == F.col("r.part")))
    got = {}
    for r in both.groupBy("l.map", "root").agg(F.count(F.lit(1)).alias("n")).collect():
        got.setdefault(r["map"], []).append(((r.root >> 32, r.root & 0xFFFFFFFF), r.n))
    want = {name: whole_map_areas(mask) for name, mask in MASKS.items()}
    assert {k: sorted(v) for k, v in got.items()} == {**want, None: [((3, 3), 1)]}


def frame(spark, mask):
    return spark.createDataFrame([(i * 2.0 - 20, j * 2.0 + 100, float(v)) for (i, j), v in np.ndenumerate(mask.astype(float))], "lat double, lon double, v double").repartition(3)


@pytest.mark.parametrize("name", ["noise", "chess", "snake", "rings"])
def test_outlines_are_valid_and_as_large_as_their_cells(spark, monkeypatch, name):
    monkeypatch.setattr(tiles.connected, "__defaults__", ((), 5))
    found = grid.areas_above(frame(spark, MASKS[name]), "v", threshold=0.5, min_area_km2=0.0, outline=True).collect()
    assert sorted((tuple(int(x) - 1 for x in r.label.split(":")), r.cells) for r in found) == whole_map_areas(MASKS[name])
    for r in found:
        (rings,) = G.read_wkt(r.outline)
        area = [((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum()) / 2 for a in rings]
        assert area[0] > 0 and all(a < 0 for a in area[1:]) and sum(area) == pytest.approx(4 * r.cells)
        assert G.is_valid([rings])


def test_areas_of_nothing(spark):
    assert grid.areas_above(frame(spark, MASKS["full"]), "v", threshold=5.0).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        grid.areas_above(frame(spark, MASKS["full"]), "v")


@pytest.mark.parametrize("tile", [3, 7, 256])
@pytest.mark.parametrize("width", [1, 3, 13])
def test_convolution_by_tiles_is_that_of_the_whole_map(spark, tile, width):
    rng = np.random.default_rng(width)
    kernel = rng.random(width).tolist()
    cells = [(m, i, j, float(v)) for m in ("a", "b") for (i, j), v in np.ndenumerate(rng.normal(size=(9, 16))) if rng.random() < 0.6]
    out = tiles.convolved(spark.createDataFrame(cells, "m string, i int, j int, v double").repartition(3), kernel, keys=("m",), tile=tile)
    want, reach = {}, width // 2
    for m, i, j, v in cells:
        for a in range(-reach, reach + 1):
            for b in range(-reach, reach + 1):
                want[m, i + a, j + b] = want.get((m, i + a, j + b), 0.0) + v * kernel[reach - a] * kernel[reach - b]
    got = {(r.m, r.i, r.j): r.v for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_smoothing_shuffles_cells_once(spark):
    cells = spark.createDataFrame([(1, 2, 3.0)], "i int, j int, v double")
    assert tiles.convolved(cells, [0.2, 0.6, 0.2])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert tiles.dealt(spark.range(256 * 256).selectExpr("id div 256 AS i", "id % 256 AS j"), 6, 64).count() < 256 * 256 * 1.5


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_star_contraction_of_chains_and_cycles(spark, n):
    links = [(g, k, k + 1) for g in (1, 2) for k in range(n)] + [(3, 9, 5), (3, 5, 7), (3, 7, 9), (3, 4, 4)]
    got = {(r.g, r.u): r.root for r in tiles.least_members(spark.createDataFrame(links, "g int, u long, v long"), ("g",)).collect()}
    assert got == {**{(g, k): 0 for g in (1, 2) for k in range(1, n + 1)}, (3, 7): 5, (3, 9): 5}
