"""Geometry columns: WKT, WKB and GeoJSON to parts of rings and back, and validity of polygons, on Arrow batches.

A geometry is an array of parts, a part an array of rings (the first one the shell), a ring an array of (x, y). Points and lines
are parts of one ring. Texts that can't be read, empty geometry and null give null.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<array<array<struct<x:double,y:double>>>>"
Ring = np.ndarray
Parts = list[list[Ring]]
#: Depth of brackets, and WKB and GeoJSON names, by kind: fixed values of the formats.
KINDS = {"POINT": (1, 1), "LINESTRING": (1, 2), "POLYGON": (2, 3), "MULTIPOINT": (1, 4), "MULTILINESTRING": (2, 5), "MULTIPOLYGON": (3, 6)}
NAMES = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
_HEAD = re.compile(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(ZM|Z|M)?\s*\(", re.IGNORECASE)


def _checked(parts: Parts) -> Parts | None:
    parts = [[r for r in part if len(r)] for part in parts]
    parts = [part for part in parts if part]
    return parts if parts and all(math.isfinite(x) for part in parts for r in part for x in r.ravel().tolist()) else None


def _points(text: str) -> Ring:
    rows = [p.replace("(", " ").replace(")", " ").split() for p in text.split(",")]
    if len({len(r) for r in rows}) != 1 or len(rows[0]) not in (2, 3, 4):
        raise ValueError(text[:40])
    return np.array([[float(x) for x in r[:2]] for r in rows])


def read_wkt(text: str | None) -> Parts | None:
    head = _HEAD.match(text or "")
    kind = head and head[1].upper()
    body = (text or "").rstrip()
    if kind not in KINDS or not body.endswith(")"):
        return None
    inner = body[head.end() : -1]
    try:
        if KINDS[kind][0] == 1:
            rings = [_points(inner)]
            return _checked([[rings[0][k : k + 1]] for k in range(len(rings[0]))] if kind == "MULTIPOINT" else [rings])
        if KINDS[kind][0] == 2:
            rings = [_points(r) for r in re.findall(r"\(([^()]*)\)", inner)]
            if re.sub(r"\([^()]*\)", "", inner).strip(" \t\n,"):
                return None
            return _checked([rings] if kind == "POLYGON" else [[r] for r in rings])
        return _checked([[_points(r) for r in re.findall(r"\(([^()]*)\)", part)] for part in re.findall(r"\(((?:\s*\([^()]*\)\s*,?)*)\)", inner)])
    except ValueError:
        return None


def read_wkb(data: bytes | None) -> Parts | None:
    """Either byte order; heights and measures are left out; a reference system in the header is skipped."""

    def take(at: int) -> tuple[Parts, int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 9 if kind & 0x20000000 else 5
        plain = kind & 0x0FFFFFFF
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) if kind & 0xC0000000 else 2 + (0, 1, 1, 2)[min(plain // 1000, 3)]
        plain %= 1000

        def ring(at: int, n: int) -> tuple[Ring, int]:
            flat = np.frombuffer(data, f"{order}f8", n * dims, at).reshape(n, dims)
            return flat[:, :2].astype(float), at + 8 * n * dims

        def count(at: int) -> tuple[int, int]:
            (n,) = struct.unpack_from(f"{order}I", data, at)
            if n > len(data):
                raise ValueError("a count beyond the data")
            return n, at + 4

        if plain == 1:
            one, at = ring(at, 1)
            return [[one]], at
        n, at = count(at)
        if plain == 2:
            line, at = ring(at, n)
            return [[line]], at
        if plain == 3:
            rings = []
            for _ in range(n):
                m, at = count(at)
                one, at = ring(at, m)
                rings.append(one)
            return [rings], at
        if plain in (4, 5, 6):
            parts: Parts = []
            for _ in range(n):
                more, at = take(at)
                parts += more
            return parts, at
        raise ValueError(f"WKB type {plain}")

    try:
        return _checked(take(0)[0]) if data else None
    except (ValueError, IndexError, struct.error):
        return None


def read_geojson(text: str | None) -> Parts | None:
    """A geometry, or a feature's."""
    try:
        found = json.loads(text or "null")
        found = found.get("geometry") if isinstance(found, dict) and found.get("type") == "Feature" else found
        kind, at = found["type"], found["coordinates"]
        ring = lambda points: np.array([[float(p[0]), float(p[1])] for p in points]).reshape(-1, 2)
        make: dict[str, Callable[[], Parts]] = {
            "Point": lambda: [[ring([at])]] if at else [],
            "LineString": lambda: [[ring(at)]],
            "Polygon": lambda: [[ring(r) for r in at]],
            "MultiPoint": lambda: [[ring([p])] for p in at],
            "MultiLineString": lambda: [[ring(line)] for line in at],
            "MultiPolygon": lambda: [[ring(r) for r in part] for part in at],
        }
        return _checked(make[kind]())
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return None


def _number(x: float) -> str:
    return repr(float(x)).removesuffix(".0")


def _kind_of(parts: Parts) -> str:
    """Polygons unless no ring is closed; several parts make the kind of many."""
    rings = [r for part in parts for r in part]
    base = "POINT" if all(len(r) == 1 for r in rings) else "POLYGON" if all(len(r) > 3 and r[0].tolist() == r[-1].tolist() for r in rings) else "LINESTRING"
    return base if len(parts) == 1 else "MULTI" + base


def write_wkt(parts: Parts) -> str:
    kind = _kind_of(parts)
    ring = lambda r: ", ".join(f"{_number(x)} {_number(y)}" for x, y in r.tolist())
    whole = [", ".join(f"({ring(r)})" for r in part) for part in parts]
    if kind.endswith("POLYGON"):
        return f"{kind} ({whole[0]})" if len(parts) == 1 else f"{kind} ({', '.join(f'({p})' for p in whole)})"
    return f"{kind} {whole[0]}" if len(parts) == 1 else f"{kind} ({', '.join(whole)})"


def write_wkb(parts: Parts) -> bytes:
    """Little-endian."""
    kind = _kind_of(parts)
    base = kind.removeprefix("MULTI")
    packed = lambda r: np.ascontiguousarray(r, "<f8").tobytes()

    def one(part: list[Ring]) -> bytes:
        head = struct.pack("<BI", 1, KINDS[base][1])
        if base == "POINT":
            return head + packed(part[0])
        if base == "LINESTRING":
            return head + struct.pack("<I", len(part[0])) + packed(part[0])
        return head + struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(r)) + packed(r) for r in part)

    return one(parts[0]) if kind == base else struct.pack("<BII", 1, KINDS[kind][1], len(parts)) + b"".join(map(one, parts))


def write_geojson(parts: Parts) -> str:
    kind = _kind_of(parts)
    base = kind.removeprefix("MULTI")
    one = lambda part: part[0][0].tolist() if base == "POINT" else part[0].tolist() if base == "LINESTRING" else [r.tolist() for r in part]
    return json.dumps({"type": NAMES[kind], "coordinates": one(parts[0]) if kind == base else [one(p) for p in parts]})


def nested(values: list[Parts | None]) -> pa.Array:
    """Parts as an Arrow array of PARTS."""
    def lists(sizes: list[int], inner, mask=None):
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=mask)

    parts = [p for v in values if v is not None for p in v]
    rings = [r for p in parts for r in p]
    points = np.concatenate([np.zeros((0, 2)), *rings])
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], ["x", "y"])
    return lists([len(v or []) for v in values], lists([len(p) for p in parts], lists([len(r) for r in rings], xy)), pa.array([v is None for v in values]))


class Flat(NamedTuple):
    """Geometries of a batch: offsets of their parts, of the parts' rings and of the rings' points, the points, and which aren't null."""

    parts: np.ndarray
    rings: np.ndarray
    points: np.ndarray
    xy: np.ndarray
    known: np.ndarray


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def flat_of(column: pa.Array) -> Flat:
    """Of an Arrow array of PARTS; null parts and rings are left out."""
    offsets = []
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for _ in range(3):
        size = pc.list_value_length(column)
        size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
        column = pc.list_flatten(column)
        if len(offsets) < 2 and column.null_count:
            here = column.is_valid()
            size = np.bincount(np.repeat(np.arange(len(size)), size)[here.to_numpy(zero_copy_only=False)], minlength=len(size))
            column = column.filter(here)
        offsets.append(_offsets(size))
    return Flat(*offsets, np.column_stack([column.field(k).to_numpy(zero_copy_only=False) for k in range(2)]), known)


def flat_of_parts(values: list[Parts | None]) -> Flat:
    parts = [p for v in values if v for p in v]
    rings = [r for p in parts for r in p]
    size = lambda of: _offsets(np.fromiter((len(x) if x else 0 for x in of), np.int64, len(of)))
    points = _offsets(np.fromiter(map(len, rings), np.int64, len(rings)))
    return Flat(size(values), size(parts), points, np.concatenate([np.zeros((0, 2)), *rings]), np.array([v is not None for v in values], bool))


def parts_at(flat: Flat, row: int) -> Parts | None:
    if not flat.known[row]:
        return None
    ring = lambda r: flat.xy[flat.points[r] : flat.points[r + 1]]
    return [[ring(r) for r in range(flat.rings[p], flat.rings[p + 1])] for p in range(flat.parts[row], flat.parts[row + 1])]


def unnested(column: pa.Array) -> Iterator[Parts | None]:
    """The other way round."""
    flat = flat_of(column)
    yield from (parts_at(flat, row) for row in range(len(column)))


def _reader(read: Callable) -> Callable[[Column | str], Column]:
    def column(c: Column | str) -> Column:
        @F.arrow_udf(PARTS)
        def run(cells: pa.Array) -> pa.Array:
            return nested([read(x) for x in cells.to_pylist()])

        return run.asNondeterministic()(c)

    return column


def _writer(write: Callable, kind: str) -> Callable[[Column | str], Column]:
    def column(c: Column | str) -> Column:
        @F.arrow_udf(kind)
        def run(cells: pa.Array) -> pa.Array:
            return pa.array([write(x) if x else None for x in unnested(cells)], pa.binary() if kind == "binary" else pa.string())

        return run.asNondeterministic()(c)

    return column


#: Columns of texts or bytes to columns of PARTS, and back. They count as nondeterministic, as the optimizer would else run them anew for
#: every column that is made of theirs.
parts_of_wkt, parts_of_wkb, parts_of_geojson = _reader(read_wkt), _reader(read_wkb), _reader(read_geojson)
wkt_of, wkb_of, geojson_of = _writer(write_wkt, "string"), _writer(write_wkb, "binary"), _writer(write_geojson, "string")


# Validity


def inside(ring: Ring, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside a ring, by the parity of edges to their left; points of the boundary may go either way."""
    a, b = ring[:-1], ring[1:]
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), 256):
        px, py = x[k : k + 256, None], y[k : k + 256, None]
        spans = (a[:, 1] > py) != (b[:, 1] > py)
        side = (b[:, 0] - a[:, 0]) * (py - a[:, 1]) - (b[:, 1] - a[:, 1]) * (px - a[:, 0])
        out[k : k + 256] = ((spans & np.where(b[:, 1] > a[:, 1], side < 0, side > 0)).sum(1) % 2) == 1
    return out


def _meetings(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of edges whose bounds meet, by a sweep in x, some at a time."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    start = low[order, 0]
    ends = np.searchsorted(start, high[order, 0], "right")
    size = np.maximum(ends - np.arange(len(a)) - 1, 0)
    k = 0
    while k < len(a):
        stop = max(k + 1, int(np.searchsorted(np.cumsum(size), (np.cumsum(size)[k - 1] if k else 0) + (1 << 18), "right")))
        some = np.repeat(np.arange(k, stop), size[k:stop])
        if len(some):
            nth = np.arange(len(some)) - np.repeat(np.cumsum(size[k:stop]) - size[k:stop], size[k:stop])
            i, j = order[some], order[some + 1 + nth]
            near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
            yield np.minimum(i, j)[near], np.maximum(i, j)[near]
        k = stop


def _two_diff(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = a - b
    back = a - d
    return d, (a - (d + back)) + (back - b)


def _two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ah, bh = 134217729.0 * a - (134217729.0 * a - a), 134217729.0 * b - (134217729.0 * b - b)
    al, bl, p = a - ah, b - bh, a * b
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def sides(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`geo.side` of arrays: above 0 left of the line from a to b, below 0 right of it, 0 on it, whatever the rounding."""
    left, right = (bx - ax) * (y - ay), (by - ay) * (x - ax)
    out = left - right
    k = np.flatnonzero(np.abs(out) < 3.3306690738754716e-16 * (np.abs(left) + np.abs(right)))
    if len(k):
        (u, ut), (v, vt), (w, wt), (z, zt) = _two_diff(bx[k], ax[k]), _two_diff(y[k], ay[k]), _two_diff(by[k], ay[k]), _two_diff(x[k], ax[k])
        (p, pt), (q, qt) = _two_product(u, v), _two_product(w, z)
        (hi, hit), (lo, lot) = _two_diff(p, q), _two_diff(pt, qt)
        total, rest = _two_diff(hi, -lo)
        out[k] = total + (rest + (lot + hit + ((u * vt + ut * v) - (w * zt + wt * z) + (ut * vt - wt * zt))))
    return out


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sign(sides(a[:, 0], a[:, 1], b[:, 0], b[:, 1], p[:, 0], p[:, 1]))


def is_valid(parts: Parts | None) -> bool:
    """A polygon or several, as simple features have it: rings close and have three corners at least; no edges cross or run along
    one another; a ring doesn't touch itself; two rings touch at one point at most; holes lie in their shell and in no other hole; parts
    don't overlap. Lines, points and null aren't valid polygons."""
    if not parts:
        return False
    rings, owner = [], []
    for n, part in enumerate(parts):
        for k, ring in enumerate(part):
            if len(ring) < 4 or not np.isfinite(ring).all() or (ring[0] != ring[-1]).any():
                return False
            ring = ring[np.concatenate([[True], (np.diff(ring, axis=0) != 0).any(1)])]  # a point may be repeated
            if len(ring) < 4:
                return False
            rings.append(ring)
            owner.append((n, k))
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    of = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    first = np.concatenate([[0], np.cumsum([len(r) - 1 for r in rings])])
    touches: dict[tuple[int, int], set] = {}
    for i, j in _meetings(a, b):
        s1, s2, s3, s4 = _side(a[i], b[i], a[j]), _side(a[i], b[i], b[j]), _side(a[j], b[j], a[i]), _side(a[j], b[j], b[i])
        if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
            return False
        flat = (s1 == 0) & (s2 == 0)
        if flat.any():  # on one line: more than a point in common is an overlap
            axis = (np.abs(b[i] - a[i])[:, 0] < np.abs(b[i] - a[i])[:, 1]).astype(int)
            pick = lambda p: p[np.arange(len(p)), axis]  # noqa: B023, E731
            lo = np.maximum(np.minimum(pick(a[i]), pick(b[i])), np.minimum(pick(a[j]), pick(b[j])))
            hi = np.minimum(np.maximum(pick(a[i]), pick(b[i])), np.maximum(pick(a[j]), pick(b[j])))
            if (flat & (hi > lo)).any():
                return False
        for points, on, against in ((a[j], s1 == 0, i), (a[i], s3 == 0, j)):
            within = on & (points >= np.minimum(a[against], b[against])).all(1) & (points <= np.maximum(a[against], b[against])).all(1)
            own = j if against is i else i
            for e, f, p in zip(own[within], against[within], points[within], strict=True):
                if of[e] == of[f]:
                    m = first[of[e] + 1] - first[of[e]]
                    if (e - f) % m not in (1, m - 1) or not ((p == b[f]).all() or (p == a[f]).all()):
                        return False
                    if not ((p == b[f]).all() and (e - f) % m == 1 or (p == a[f]).all() and m == 1):
                        return False
                else:
                    touches.setdefault((min(of[e], of[f]), max(of[e], of[f])), set()).add(tuple(p))
    if any(len(t) > 1 for t in touches.values()):
        return False
    for x in range(len(rings)):
        for y in range(len(rings)):
            if x == y:
                continue
            (n, k), (m, h) = owner[x], owner[y]
            box = (rings[x].min(0) >= rings[y].min(0)).all() and (rings[x].max(0) <= rings[y].max(0)).all()
            if n == m and h == 0 and k > 0 and not (box and _in(rings[x], rings[y])):
                return False  # a hole outside its shell
            if n == m and h > 0 and k > 0 and box and _in(rings[x], rings[y]):
                return False  # a hole in a hole
            if n != m and k == 0 and h == 0 and box and _in(rings[x], rings[y]):
                holes = [rings[z] for z in range(len(rings)) if owner[z][0] == m and owner[z][1] > 0]
                if not any(_in(rings[x], hole) for hole in holes):
                    return False  # a part inside another one
    return True


def _in(ring: Ring, other: Ring) -> bool:
    """Of rings that don't cross: middles of the edges that aren't on the other ring tell."""
    middle = (ring[:-1] + ring[1:]) / 2
    return bool(inside(other, middle[:, 0], middle[:, 1]).mean() > 0.5)


#: Edges of a geometry up to which it is judged together with others.
TOGETHER = 64


def _each(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the index of each, repeated, and 0, 1, ... within it."""
    at = np.repeat(np.arange(len(size)), size)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)


def are_valid(flat: Flat) -> np.ndarray:
    """`is_valid` of every geometry of a batch: small ones together, the others one by one."""
    of_part = np.repeat(np.arange(len(flat.known)), np.diff(flat.parts))
    of_ring, nth = _each(np.diff(flat.rings))
    row, part = of_part[of_ring], of_ring
    ring, at = _each(np.diff(flat.points))
    good = flat.known & (np.diff(flat.parts) > 0)
    # Points that repeat the one before are left out.
    again = np.concatenate([[False], (flat.xy[1:] == flat.xy[:-1]).all(1)])[: len(at)] & (at > 0)
    left = np.diff(flat.points) - np.bincount(ring[again], minlength=len(row))
    first, last = np.minimum(flat.points[:-1], max(len(at) - 1, 0)), flat.points[1:] - 1
    sound = (left >= 4) & (np.bincount(ring[~np.isfinite(flat.xy).all(1)], minlength=len(row)) == 0)
    sound[sound] &= (flat.xy[first[sound]] == flat.xy[last[sound]]).all(1)
    good[row[~sound]] = False
    edges = np.bincount(row, np.maximum(left - 1, 0), minlength=len(good))
    alone = good & (edges > TOGETHER)
    for k in np.flatnonzero(alone):
        good[k] = is_valid(parts_at(flat, k))
    seen = good & ~alone
    keep = seen[row]
    stays = keep[ring] & ~again
    xy, row, part, nth, left = flat.xy[stays], row[keep], part[keep], nth[keep], left[keep]
    if not len(row):
        return good
    ends = np.cumsum(left) - 1
    start = np.ones(len(xy), bool)
    start[ends] = False
    a, b = xy[:-1][start[:-1]], xy[1:][start[:-1]]
    m = left - 1
    of, _ = _each(m)
    bad = np.zeros(len(good), bool)
    low, high = np.minimum(a, b), np.maximum(a, b)
    stop = np.searchsorted(row[of], row[of], "right")
    more = stop - np.arange(len(of)) - 1
    cuts = np.searchsorted(np.cumsum(more), np.arange(0, more.sum(), 1 << 18), "left")
    touches = []
    for k, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
        own, step = _each(more[k:z])
        i = own + k
        j = i + 1 + step
        near = (low[i] <= high[j]).all(1) & (low[j] <= high[i]).all(1)
        i, j = i[near], j[near]
        s1, s2, s3, s4 = _side(a[i], b[i], a[j]), _side(a[i], b[i], b[j]), _side(a[j], b[j], a[i]), _side(a[j], b[j], b[i])
        wrong = (s1 * s2 < 0) & (s3 * s4 < 0)
        line = np.flatnonzero((s1 == 0) & (s2 == 0))
        axis = (np.abs(b - a)[i[line], 0] < np.abs(b - a)[i[line], 1]).astype(int)
        wrong[line] |= np.minimum(high[i[line], axis], high[j[line], axis]) > np.maximum(low[i[line], axis], low[j[line], axis])
        bad[row[of[i[wrong]]]] = True
        for p, on, e, f in ((a[j], s1 == 0, j, i), (a[i], s3 == 0, i, j)):
            within = on & (p >= low[f]).all(1) & (p <= high[f]).all(1)
            e, f, p = e[within], f[within], p[within]
            same = of[e] == of[f]
            d = (e - f) % m[of[e]]
            follows = (p == b[f]).all(1) & (d == 1) | (p == a[f]).all(1) & (d == m[of[e]] - 1)
            bad[row[of[e[same & ~follows]]]] = True
            e, f = of[e[~same]], of[f[~same]]
            touches.append(np.column_stack([np.minimum(e, f), np.maximum(e, f), p[~same]]))
    met = np.concatenate([np.zeros((0, 4)), *touches])
    met = met[np.lexsort(met.T[::-1])]
    # The next point at which the same two rings touch is another one.
    twice = (met[1:, :2] == met[:-1, :2]).all(1) & (met[1:, 2:] != met[:-1, 2:]).any(1)
    bad[row[met[1:][twice, 0].astype(int)]] = True

    begin = np.concatenate([[0], np.cumsum(m)])
    box = np.minimum.reduceat(low, begin[:-1]), np.maximum.reduceat(high, begin[:-1])
    x, k = _each(np.bincount(row, minlength=len(good))[row])
    y = np.searchsorted(row, row, "left")[x] + k
    hole = (part[x] == part[y]) & (nth[x] > 0) & (x != y)
    asked = hole | (part[x] != part[y]) & (nth[x] == 0) & (nth[y] == 0)
    x, y, hole = x[asked], y[asked], hole[asked]
    inner = (box[0][x] >= box[0][y]).all(1) & (box[1][x] <= box[1][y]).all(1)
    bad[row[x[hole & ~inner & (nth[y] == 0)]]] = True
    x, y, hole = x[inner], y[inner], hole[inner]
    # Of rings that don't cross: the middles of one's edges by the other's edges.
    pair, e = _each(m[x])
    mid = ((a + b) / 2)[begin[x][pair] + e]
    point, e = _each(m[y][pair])
    f = begin[y][pair][point] + e
    px, py = mid[point].T
    spans = (a[f, 1] > py) != (b[f, 1] > py)
    side = (b[f, 0] - a[f, 0]) * (py - a[f, 1]) - (b[f, 1] - a[f, 1]) * (px - a[f, 0])
    odd = np.bincount(point[spans & np.where(b[f, 1] > a[f, 1], side < 0, side > 0)], minlength=len(pair)) % 2
    within = np.bincount(pair, odd, minlength=len(x)) / m[x] > 0.5
    bad[row[x[hole & (within != (nth[y] == 0))]]] = True
    # A part in another one may be in its hole.
    holes = np.isin(part, part[nth > 0])
    bad[row[x[~hole & within & ~holes[y]]]] = True
    for k in np.unique(row[x[~hole & within & holes[y]]]):
        bad[k] |= not is_valid(parts_at(flat, k))
    return good & ~bad


def valid(c: Column) -> Column:
    """Whether a column of PARTS is a valid polygon."""
    @F.arrow_udf("boolean")
    def run(cells: pa.Array) -> pa.Array:
        return pa.array(are_valid(flat_of(cells)))

    return run(c)


def centroids(flat: Flat) -> np.ndarray:
    """`geo.centroid` of every geometry of a batch that has points."""
    ring, at = _each(np.diff(flat.points))
    row = np.repeat(np.arange(len(flat.known)), np.diff(flat.parts))[np.repeat(np.arange(len(flat.rings) - 1), np.diff(flat.rings))][ring]
    n = np.bincount(row, minlength=len(flat.known))
    first = flat.xy[np.minimum(np.cumsum(n) - n, max(len(row) - 1, 0))] if len(row) else np.zeros((len(n), 2))
    total = lambda of, v: np.bincount(of, v, minlength=len(n))
    ahead = np.flatnonzero(at[1:] > 0) if len(at) else np.zeros(0, int)
    of = row[ahead]
    (ax, ay), (bx, by) = (flat.xy[ahead] - first[of]).T, (flat.xy[ahead + 1] - first[of]).T
    cross = ax * by - bx * ay
    area = total(of, cross)
    with np.errstate(invalid="ignore", divide="ignore"):
        by_area = first + np.column_stack([total(of, (ax + bx) * cross), total(of, (ay + by) * cross)]) / (3 * area)[:, None]
        mean = np.column_stack([total(row, flat.xy[:, k]) for k in range(2)]) / n[:, None]
    return np.where(np.abs(area)[:, None] < 1e-12, mean, by_area)


def valid_centroid(wkt: Column) -> Column:
    """Struct of x and y: the centroid of WKT that is a valid polygon, or several; null for all else."""
    @F.arrow_udf("x double, y double")
    def run(texts: pa.Array) -> pa.Array:
        flat = flat_of_parts([read_wkt(t) for t in texts.to_pylist()])
        xy, none = centroids(flat), ~are_valid(flat)
        return pa.StructArray.from_arrays([pa.array(xy[:, k].copy()) for k in range(2)], ["x", "y"], mask=pa.array(none))

    return run.asNondeterministic()(wkt)  # else filters on it run it again
