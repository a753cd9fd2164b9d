"""Geometry in text form: parsing, centroids, envelopes, lengths and point tests, as column expressions.

A polygon is an array of rings, a ring an array of (x, y). A point is inside if a ray from it crosses an odd number of
edges, which also handles holes. A region of several parts is a list of polygons, and a point of any part is inside.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import MERCATOR_M, col

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = (lambda n: f" *+{n} ++{n} *+")(r"[-+]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][-+]?+\d++)?+")
#: One ring, line or point with two plain numbers a point. No part is tried twice, so long texts take no deep stack.
PLAIN = rf"^ *+[A-Za-z]++ *+\(++{_PAIR}(?:,{_PAIR})*+\)++ *+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: lambda variables aren't expanded."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _points(ring: Column) -> Column:
    number = lambda p, k: F.try_element_at(p, F.lit(k)).try_cast("double")
    pairs = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))


def wkt_rings(wkt: Column | str) -> Column:
    """Rings (or lines, or the point) of WKT text; null if it is blank, EMPTY or has a coordinate that is no number."""
    text = F.trim(col(wkt))
    rings = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), _points)
    bad = lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull())
    return let(rings, lambda g: F.when((F.size(g) > 0) & ~F.exists(g, bad), g))


def readable(wkt: Column | str) -> Column:
    """Whether `wkt_rings` gives rings with a centroid. Only texts that don't look plain are parsed for it."""
    return F.coalesce(F.when(col(wkt).rlike(PLAIN), True).otherwise(centroid(wkt_rings(wkt))["x"].isNotNull()), F.lit(False))


def is_valid_polygon(rings: Column) -> Column:
    """Every ring has four points at least and ends where it began; null geometry is not valid."""
    ok = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, ok), F.lit(False))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, _edges))


def _sum(edges: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + f(e))


def centroid(rings: Column) -> Column:
    """Area centroid by the shoelace rule, holes (rings the other way round) taken off; the mean of the points of a
    line or of a polygon without area."""

    def of(g: Column) -> Column:
        # Coordinates are taken from the first point, so the products stay small.
        first = F.element_at(F.element_at(g, 1), 1)
        edge = lambda e: F.struct((e["a"]["x"] - first["x"]).alias("ax"), (e["a"]["y"] - first["y"]).alias("ay"), (e["b"]["x"] - first["x"]).alias("bx"), (e["b"]["y"] - first["y"]).alias("by"))
        cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]

        def by_area(edges: Column) -> Column:
            sums = F.struct(_sum(edges, cross).alias("a"), _sum(edges, lambda e: (e["ax"] + e["bx"]) * cross(e)).alias("x"), _sum(edges, lambda e: (e["ay"] + e["by"]) * cross(e)).alias("y"))
            mean = lambda k: let(F.flatten(g), lambda p: _sum(p, lambda q: q[k]) / F.size(p))
            part = lambda s, k: first[k] + s[k] / (3 * s["a"])
            flat = lambda s: F.abs(s["a"]) < 1e-12
            return let(sums, lambda s: F.struct(F.when(flat(s), mean("x")).otherwise(part(s, "x")).alias("x"), F.when(flat(s), mean("y")).otherwise(part(s, "y")).alias("y")))

        return let(F.transform(_all_edges(g), edge), by_area)

    return F.when(rings.isNotNull(), let(rings, of))


def envelope(rings: Column) -> Column:
    """Struct of xmin, ymin, xmax, ymax."""
    of = lambda p, k, f: f(F.transform(p, lambda q: q[k]))
    return let(F.flatten(rings), lambda p: F.struct(of(p, "x", F.array_min).alias("xmin"), of(p, "y", F.array_min).alias("ymin"), of(p, "x", F.array_max).alias("xmax"), of(p, "y", F.array_max).alias("ymax")))


def envelopes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def _two_diff(a: Column, b: Column) -> Column:
    """Struct of a - b, rounded, and what the rounding left out."""

    def rest(d: Column) -> Column:
        back = a - d
        return F.struct(d.alias("h"), ((a - (d + back)) + (back - b)).alias("t"))

    return let(a - b, rest)


def _two_product(a: Column, b: Column) -> Column:
    """Struct of a * b, rounded, and what the rounding left out, by halves of 26 bits."""
    high = lambda c: F.lit(134217729.0) * c - (F.lit(134217729.0) * c - c)

    def rest(s: Column) -> Column:
        al, bl, p = a - s["a"], b - s["b"], a * b
        return F.struct(p.alias("h"), (al * bl - (((p - s["a"] * s["b"]) - al * s["b"]) - s["a"] * bl)).alias("t"))

    return let(F.struct(high(a).alias("a"), high(b).alias("b")), rest)


def side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Above 0 left of the line from a to b, below 0 right of it, 0 on it. Where rounding could change the sign, products are made
    of two doubles each, so the sign is that of the coordinates as they are, or within a part in 2 ** 100 if their differences are rounded too."""
    left, right = (bx - ax) * (y - ay), (by - ay) * (x - ax)

    def exact(d: Column) -> Column:
        u, v, w, z = d["u"], d["v"], d["w"], d["z"]
        tail = (u["h"] * v["t"] + u["t"] * v["h"]) - (w["h"] * z["t"] + w["t"] * z["h"]) + (u["t"] * v["t"] - w["t"] * z["t"])

        def four(m: Column) -> Column:
            p, q = m["p"], m["q"]
            total = lambda s: let(_two_diff(s["hi"]["h"], -s["lo"]["h"]), lambda t: t["h"] + (t["t"] + (s["lo"]["t"] + s["hi"]["t"] + tail)))
            return let(F.struct(_two_diff(p["h"], q["h"]).alias("hi"), _two_diff(p["t"], q["t"]).alias("lo")), total)

        return let(F.struct(_two_product(u["h"], v["h"]).alias("p"), _two_product(w["h"], z["h"]).alias("q")), four)

    parts = F.struct(_two_diff(bx, ax).alias("u"), _two_diff(y, ay).alias("v"), _two_diff(by, ay).alias("w"), _two_diff(x, ax).alias("z"))
    return F.when(F.abs(left - right) >= F.lit(3.3306690738754716e-16) * (F.abs(left) + F.abs(right)), left - right).otherwise(let(parts, exact))


def point_in_polygon(x: Column | str, y: Column | str, rings: Column) -> Column:
    """Inside or on the boundary, by the exact side of each edge."""
    x, y = col(x).cast("double"), col(y).cast("double")

    def seen(e: Column) -> Column:
        a, b = e["a"], e["b"]
        box = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return F.struct(side(a["x"], a["y"], b["x"], b["y"], x, y).alias("s"), box.alias("box"), (b["y"] > a["y"]).alias("up"), ((a["y"] > y) != (b["y"] > y)).alias("spans"))

    on = lambda e: (e["s"] == 0) & e["box"]
    crossed = lambda e: e["spans"] & F.when(e["up"], e["s"] > 0).otherwise(e["s"] < 0)
    return let(F.transform(_all_edges(rings), seen), lambda es: F.exists(es, on) | (F.size(F.filter(es, crossed)) % 2 == 1))


def mercator_length_km(rings: Column) -> Column:
    """Length of lines in the spherical Mercator plane, km."""
    x = lambda p: F.lit(MERCATOR_M) * F.radians(p["x"])
    y = lambda p: F.lit(MERCATOR_M) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(p["y"]) / 2))
    step = lambda e: F.sqrt(F.pow(x(e["b"]) - x(e["a"]), F.lit(2)) + F.pow(y(e["b"]) - y(e["a"]), F.lit(2)))
    return F.aggregate(_all_edges(rings), F.lit(0.0), lambda acc, e: acc + step(e)) / 1000


def point_wkt(x: Column | str, y: Column | str) -> Column:
    return F.concat(F.lit("POINT ("), col(x).cast("string"), F.lit(" "), col(y).cast("string"), F.lit(")"))


def wkb_parts(wkb: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons (lists of rings) of a WKB polygon or multipolygon, for a region that one row describes."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", wkb, at + 1)
        at, rings = at + 9, []
        if kind == 6:
            parts = []
            for _ in range(n):
                more, at = read(at)
                parts += more
            return parts, at
        elif kind == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(f"{order}I", wkb, at)
                flat = struct.unpack_from(f"{order}{2 * m}d", wkb, at + 4)
                rings.append(list(zip(flat[::2], flat[1::2], strict=True)))
                at += 4 + 16 * m
        else:
            raise ValueError(f"a polygon or multipolygon is needed, not WKB type {kind}")
        return [rings], at

    return read(0)[0]


def rings_literal(rings: list[list[tuple[float, float]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in rings])
