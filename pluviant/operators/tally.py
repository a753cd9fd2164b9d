"""Counts of points and of distinct keys in a table of regions, without a row for each point and region and without a cover: points are
dealt to tiles as summed places, regions to the tiles they touch, and a tile's places are counted region by region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import sides, unnested
from ..session import stored
from .cover import LEVELS, PAIRED, closed_of, level_of, lines_of, spread, tested

#: Tiles are 2 ** level degrees, with levels STEP apart: a region is in tiles at least as wide and as high as it is.
FIRST, STEP = -7, 4
#: Places that are summed before they are dealt, rows that a tile reaches up to which it is one group, and strips of a tile.
SUMMED, CHUNK, STRIPS = 1 << 19, 4_000_000, 32
_TILE = ["__level", "__bi", "__bj"]


def _bounds(parts: Column) -> Column:
    """x0, y0, x1, y1 of a column of PARTS, null without geometry."""
    @F.arrow_udf("struct<x0:double,y0:double,x1:double,y1:double>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for parts in unnested(column):
            at = np.concatenate([r for part in closed for r in part]) if (closed := closed_of(parts)) else None
            out.append(None if at is None else dict(zip(("x0", "y0", "x1", "y1"), map(float, (*at.min(0), *at.max(0))), strict=True)))
        return pa.array(out, pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]))

    return run(parts)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _placed(x: np.ndarray, y: np.ndarray, n: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """n and u summed by place."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = _firsts(x, y)
    return (x[first], y[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in (n, u)))


def _dealt(reach: dict[int, tuple[float, float]], kind: pa.DataType):
    """Of rows (key, x, y) sorted by key: places summed, each for its tile of every level; and for tiles whose regions may hold several
    places of one key, those places with their key, so that the key is counted once.

    Regions of a tile begin in it and reach over the next ones by `reach` at most, so places of a key that no such region holds both of don't
    meet. A key of up to PAIRED places counts with each (u is 1), and its places with a key take off as much again (u is -1); a key of more has
    all its places with a key and counts by these alone."""
    names = [*_TILE, "__kind", "__x", "__y", "__n", "__u", "__key"]

    def batch(level, bi, bj, which, x, y, n, u, key) -> Iterator[pa.RecordBatch]:
        size = len(x)
        columns = [pa.array(np.full(size, level), pa.int32()), pa.array(bi, pa.int64()), pa.array(bj, pa.int64()), pa.array(np.full(size, which), pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(n, pa.int64()), pa.array(u, pa.int64()), pa.nulls(size, kind) if key is None else key]
        whole = pa.RecordBatch.from_arrays(columns, names)
        yield from (whole.slice(k, 1 << 16) for k in range(0, size, 1 << 16))

    def weights(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        x, y, n, u = _placed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for level in reach:
            yield from batch(level, *(np.floor(c / 2.0**level).astype(np.int64) for c in (x, y)), 0, x, y, n, u, None)

    def meant(level: int, low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tiles whose regions may reach places as far apart as low and high, with each of the rows."""
        size, far = 2.0**level, reach[level]
        begin = [np.floor((h - w) / size).astype(np.int64) for h, w in zip(high, far, strict=True)]
        wide, tall = (np.maximum(np.floor(c / size).astype(np.int64) - b + 1, 0) for c, b in zip(low, begin, strict=True))
        at, nth = spread(wide * tall)
        bi, bj = begin[0][at] + nth // np.maximum(tall[at], 1), begin[1][at] + nth % np.maximum(tall[at], 1)
        bi, bj, row = np.tile(bi, len(rows)), np.tile(bj, len(rows)), np.concatenate([r[at] for r in rows])
        order = np.lexsort((row, bj, bi))
        bi, bj, row = bi[order], bj[order], row[order]
        first = _firsts(bi, bj, row)
        return bi[first], bj[first], row[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, many = [], 0, None, None  # places to be summed; rows of the last key; a key of too many places that goes on

        def settled(keys: pa.Array, code: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, going: bool) -> Iterator[pa.RecordBatch]:
            """Places of whole keys (sorted by code); `going`: the first key has more places than PAIRED already."""
            nonlocal size
            paired = np.bincount(code, minlength=len(keys)) <= PAIRED
            paired[0] &= not going
            few = paired[code]
            held.append((x, y, n, few.astype(np.int64)))
            size += len(x)
            close: dict[int, list[np.ndarray]] = {level: [] for level in reach}
            for d in range(1, PAIRED):
                i = np.flatnonzero(few[:-d] & (code[d:] == code[:-d])) if len(code) > d else np.zeros(0, int)
                if not len(i):
                    break
                for level, (w, h) in reach.items():
                    close[level].append(k := i[(np.abs(x[i + d] - x[i]) <= w) & (np.abs(y[i + d] - y[i]) <= h)])
                    close[level].append(k + d)
            lots = np.flatnonzero(~few)
            for level in reach:
                if close[level] and sum(map(len, close[level])):
                    i, j = np.concatenate(close[level][::2]), np.concatenate(close[level][1::2])
                    bi, bj, row = meant(level, (np.minimum(x[i], x[j]), np.minimum(y[i], y[j])), (np.maximum(x[i], x[j]), np.maximum(y[i], y[j])), [i, j])
                    yield from batch(level, bi, bj, 1, x[row], y[row], np.zeros(len(row)), np.full(len(row), -1), keys.take(pa.array(code[row])))
                if len(lots):
                    bi, bj, row = meant(level, (x[lots], y[lots]), (x[lots], y[lots]), [lots])
                    yield from batch(level, bi, bj, 1, x[row], y[row], np.zeros(len(row)), np.zeros(len(row)), keys.take(pa.array(code[row])))
            if size > SUMMED:
                yield from weights(held)
                held.clear()
                size = 0

        for b in batches:
            known = b.column(0).is_valid()
            x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            if b.column(0).null_count:
                gone = ~known.to_numpy(zero_copy_only=False)
                held.append((x[gone], y[gone], np.ones(gone.sum(), np.int64), np.zeros(gone.sum(), np.int64)))
                size, x, y = size + int(gone.sum()), x[~gone], y[~gone]
                if size > SUMMED:
                    yield from weights(held)
                    held.clear()
                    size = 0
            if not len(x):
                continue
            column, n = b.column(0).filter(known), np.ones(len(x), np.int64)
            if last is not None:
                column, x, y, n = pa.concat_arrays([last[0], column]), *(np.concatenate(c) for c in zip(last[1:], (x, y, n), strict=True))
            found = pc.dictionary_encode(column)
            keys, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((y, x, code))
            code, x, y = code[order], x[order], y[order]
            first = _firsts(code, x, y)
            code, x, y, n = code[first], x[first], y[first], np.add.reduceat(n[order], first)
            going = many is not None and keys[0].equals(many)
            start = int(np.searchsorted(code, len(keys) - 1))
            if len(x) - start > PAIRED or going and len(keys) == 1:
                many, last, start = keys[len(keys) - 1], None, len(x)
            else:
                many, last = None, (keys.take(pa.array(code[start:])), x[start:], y[start:], n[start:])
            if start:
                yield from settled(keys, code[:start], x[:start], y[:start], n[:start], going)
        if last is not None:
            yield from settled(last[0].slice(0, 1), np.zeros(len(last[1]), int), *last[1:], False)
        if size:
            yield from weights(held)

    return run


class _Places:
    """Places of a tile in strips, ordered by y in each, with their smallest cells; keys of places by code."""

    def __init__(self, level: int, weights: list[tuple[np.ndarray, ...]], keyed: list[tuple]) -> None:
        self.strip = 2.0**level / STRIPS
        wx, wy, wn, wu = _placed(*(np.concatenate(c) for c in zip(*weights, strict=True))) if weights else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.weights = self._ordered(wx, wy, wn, wu)
        if keyed:
            code = pc.dictionary_encode(pa.concat_arrays([k[0] for k in keyed])).indices.to_numpy(zero_copy_only=False)
            kx, ky, ku = (np.concatenate([k[n] for k in keyed]) for n in (1, 2, 3))
            self.keyed = self._ordered(kx, ky, ku, code)
            self.seen = np.zeros(int(code.max()) + 1, np.int64)
        else:
            self.keyed = None

    def _ordered(self, x: np.ndarray, y: np.ndarray, *more: np.ndarray) -> tuple:
        strip = np.floor(x / self.strip).astype(np.int64)
        order = np.lexsort((y, strip))
        low = int(strip.min()) if len(x) else 0
        starts = np.searchsorted(strip[order], np.arange(low, (int(strip.max()) if len(x) else -1) + 2))
        x, y = x[order], y[order]
        return low, starts, x, y, *(np.floor(c / 2.0 ** LEVELS[0]).astype(np.int64) for c in (x, y)), *(c[order] for c in more)

    def near(self, rows: tuple, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
        low, starts, _, y = rows[:4]
        ends = []
        for k in range(max(int(np.floor(x0 / self.strip)) - low, 0), min(int(np.floor(x1 / self.strip)) - low + 1, len(starts) - 1)):
            own = y[starts[k] : starts[k + 1]]
            ends.append((starts[k] + own.searchsorted(y0, "left"), starts[k] + own.searchsorted(y1, "right")))
        if not ends:
            return np.zeros(0, int)
        begin, end = np.array(ends).T
        at, nth = spread(end - begin)
        return begin[at] + nth

    def count(self, region: "_Region", home: bool) -> tuple[int, int]:
        """Rows and keys of the places of this tile in the region; at home, what places with a key change in keys."""
        at = self.near(self.weights, *region.bounds)
        at = at[region.holds(self.weights, at)]
        n, u = (int(c[at].sum()) for c in self.weights[6:])
        if home and self.keyed is not None:
            at = self.near(self.keyed, *region.bounds)
            at = at[region.holds(self.keyed, at)]
            code, nth = self.keyed[7][at], np.arange(len(at))
            self.seen[code] = nth
            u += int((self.seen[code] == nth).sum()) + int(self.keyed[6][at].sum())
        return n, u


class _Region:
    """Cells of a region, as a table of a cell's number for each of its parts: below 0 outside, 0 whole, else a test."""

    def __init__(self, parts: list) -> None:
        level = level_of([r for part in parts for r in part])
        self.size, self.shift = 2.0**level, level - LEVELS[0]
        at = np.concatenate([r for part in parts for r in part])
        self.bounds = (*at.min(0).tolist(), *at.max(0).tolist())
        self.parts = []
        for part in parts:
            columns, rows, reference, within, first, ends, edges, runs = lines_of(part, self.size)
            i, j = columns.min(), rows.min()
            table = np.full((rows.max() - j + 1, columns.max() - i + 1), -1, np.int32)
            for row, start, stop in runs:
                table[row - j, start - i : stop - i] = 0
            table[rows - j, columns - i] = np.arange(1, len(rows) + 1)
            edges = np.ascontiguousarray(edges.T)
            left = sides(*edges, *np.repeat(reference, ends - first, axis=0).T) > 0
            self.parts.append((i, j, table, np.ascontiguousarray(reference.T), within, first, ends - first, edges, left))

    def holds(self, rows: tuple, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        column, row = rows[4][at] >> self.shift, rows[5][at] >> self.shift
        for i, j, table, reference, within, first, size, edges, left in self.parts:
            # Numbers below 0 are large ones without a sign.
            c, r = (column - i).view(np.uint64), (row - j).view(np.uint64)
            k = np.flatnonzero((c < table.shape[1]) & (r < table.shape[0]))
            cell = table[r[k], c[k]]
            out[k[cell == 0]] = True
            k, cell = k[cell > 0], cell[cell > 0] - 1
            test, nth = spread(size[cell])
            own = first[cell][test] + nth
            out[k] |= tested(test, within[cell], edges[:, own], left[own], [c[at[k]] for c in rows[2:4]], reference[:, cell])
        return out


def _counted(kind: pa.DataType):
    """Rows of tiles, sorted: a tile's places, those with a key, and then regions, to counts of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, weights, keyed, size, places = None, [], [], 0, None
        for b in batches:
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            tiles = [number(c) for c in (*_TILE, "__salt", "__kind")]
            first = _firsts(*tiles)
            regions, flat, out = b.column("__region"), b.column("__parts"), []
            for start, end in zip(first, [*first[1:], len(b)], strict=True):
                *own, which = (int(c[start]) for c in tiles)
                if own != tile:
                    tile, weights, keyed, size, places = own, [], [], 0, None
                x, y, n, u = (number(c)[start:end] for c in ("__x", "__y", "__n", "__u"))
                if which == 0:
                    weights.append((x, y, n, u))
                    size += end - start
                    if size > SUMMED:
                        weights = [_placed(*(np.concatenate(c) for c in zip(*weights, strict=True)))]
                        size = 0
                elif which == 1:
                    keyed.append((b.column("__key").slice(start, end - start), x, y, u))
                elif weights or keyed:
                    places = places or _Places(own[0], weights, keyed)
                    for k, parts in enumerate(unnested(flat.slice(start, end - start)), start):
                        if (found := places.count(_Region(closed_of(parts)), bool(u[k - start]))) != (0, 0):
                            out.append((k, *found))
            if out:
                at, n, u = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([regions.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(u, pa.int64())], ["region", "n", "n_keys"])

    return run


def counts_by_region(points: DataFrame, regions: DataFrame, parts: Column | str = "parts", id_col: str = "region", key: str = "uid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """region, n (rows of points in it or on its boundary), n_keys (distinct keys of these), of regions with a point. `parts` is PARTS (functions.geometry),
    a column of `regions` or made of its columns: then it is worked out again where it is needed, so that no corners are shuffled. Rows of one id are
    parts of one region.

    What is shuffled grows with points and with regions, not with their product: points go by key once, summed places to a tile each, places of
    a key that are close together to at most four tiles a level, and regions, as their rows without `parts`, to the tiles they touch. Levels
    and tiles that too much reaches, a row for each CHUNK rows at most, come to the driver first.
    """
    parts = F.col(parts) if isinstance(parts, str) else parts
    if not regions.groupBy(id_col).count().filter("count > 1").isEmpty():
        regions, parts = regions.select(id_col, parts.alias("__all")).groupBy(id_col).agg(F.flatten(F.collect_list("__all")).alias("__all")), F.col("__all")
    side = F.greatest(F.col("__b.x1") - F.col("__b.x0"), F.col("__b.y1") - F.col("__b.y0"))
    level = F.greatest(F.lit(0), F.ceil((F.log2(side) - FIRST) / STEP)).cast("int") * STEP + FIRST
    # A filter by bounds would be pushed to before regions are dealt, and have them worked out twice.
    known = stored(regions.withColumn("__b", _bounds(parts)).withColumn("__level", F.when(side > 0, level).otherwise(FIRST))).filter("__b is not null")
    far = known.groupBy("__level").agg(F.max(F.col("__b.x1") - F.col("__b.x0")).alias("w"), F.max(F.col("__b.y1") - F.col("__b.y0")).alias("h")).collect()
    reach = {r["__level"]: (r.w * (1 + 1e-9) + 1e-9, r.h * (1 + 1e-9) + 1e-9) for r in sorted(far)}

    rows = points.select(F.col(key).alias("key"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    rows = rows.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in rows.schema)} | {"region": regions.schema[id_col].dataType.simpleString()}
    tile = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k)).cast("long")
    steps = lambda a, b, k: F.explode(F.sequence(tile(a, k), tile(b, k)))

    arrow = {c: points.sparkSession.createDataFrame([], f"v {kinds[c]}").toArrow().schema.field(0).type for c in ("key", "region")}
    sorted_keys = rows.repartition("key", F.when(F.col("key").isNull(), F.xxhash64("x", "y"))).sortWithinPartitions("key")
    dealt = sorted_keys.mapInArrow(_dealt(reach, arrow["key"]), f"__level int, __bi long, __bj long, __kind int, __x double, __y double, __n long, __u long, __key {kinds['key']}")
    touched = known.withColumn("__bi", steps(F.col("__b.x0"), F.col("__b.x1"), F.col("__level"))).withColumn("__bj", steps(F.col("__b.y0"), F.col("__b.y1"), F.col("__level")))
    home = (F.col("__bi") == tile(F.col("__b.x0"), F.col("__level"))) & (F.col("__bj") == tile(F.col("__b.y0"), F.col("__level")))
    touched = touched.withColumn("__u", home.cast("long")).withColumns({"__kind": F.lit(2), "__x": F.lit(0.0), "__y": F.lit(0.0), "__n": F.lit(0).cast("long"), "__region": F.col(id_col)}).drop("__b")

    # Tiles that too much reaches are dealt in several groups, each of which meets all their regions.
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h")) for k, (w, h) in reach.items()])) if reach else None
    if of is None:
        return points.sparkSession.createDataFrame([], f"region {kinds['region']}, n long, n_keys long")
    met = rows.select("x", "y", of.alias("o")).select(F.col("o.k").alias("__level"), "y", "o", steps(F.col("x") - F.col("o.w"), F.col("x"), F.col("o.k")).alias("__bi"))
    met = met.select("__level", "__bi", steps(F.col("y") - F.col("o.h"), F.col("y"), F.col("o.k")).alias("__bj"))
    full = met.groupBy(*_TILE).count().filter(F.col("count") > CHUNK).select(*_TILE, F.ceil(F.col("count") / CHUNK).cast("int").alias("__m")).collect()
    salts = points.sparkSession.createDataFrame(full, "__level int, __bi long, __bj long, __m int")
    salted = lambda df: df.join(F.broadcast(salts), _TILE, "left").fillna(1, ["__m"]) if full else df.withColumn("__m", F.lit(1))
    dealt = salted(dealt).withColumn("__salt", F.when(F.col("__kind") == 0, F.pmod(F.xxhash64("__x", "__y"), F.col("__m"))).otherwise(F.pmod(F.xxhash64("__key"), F.col("__m"))).cast("int"))
    touched = salted(touched).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))

    both = dealt.drop("__m").unionByName(touched.drop("__m"), allowMissingColumns=True)
    # Far more tasks than tiles, so that few have several of them.
    tasks = 32 * points.sparkSession.sparkContext.defaultParallelism
    order = [*_TILE, "__salt"]
    both = both.repartition(tasks, *order).sortWithinPartitions("__bi", "__bj", "__level", "__salt", "__kind")
    needed = both.select(*order, "__kind", "__x", "__y", "__n", "__u", "__key", "__region", F.when(F.col("__kind") == 2, parts).alias("__parts"))
    counts = needed.mapInArrow(_counted(arrow["region"]), f"region {kinds['region']}, n long, n_keys long")
    return counts.groupBy("region").agg(F.sum("n").alias("n"), F.sum("n_keys").alias("n_keys"))
