"""Centroid clustering by dual-tree Lloyd rounds over integer vectors.

Vectors are kept in blocks, each with a cover tree, in a table written once. A round builds a cover tree over the centroids
and walks pairs of nodes from both roots down: a pair goes when its least possible distance is beyond the greatest one
that the vectors' node can have to some centroid. Pairs of leaves are compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import dropped, stored

#: Vectors of a block and its tree.
BLOCK = 1024
#: Node pairs whose distances are computed at once.
PAIRS = 1 << 14
#: Components are held to this range, so that distances fit in a long.
MOST = 1 << 27


class Tree(NamedTuple):
    """A cover tree of distinct points as arrays, parents before children.

    point: a node's point; radius: the greatest distance from it to a point below; first and last: its children's range
    (empty for a leaf); begin and end: the range in `order` of the points below.
    """

    point: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    order: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...k,...k->...", d, d)


def cover_tree(points: np.ndarray) -> Tree:
    """Of distinct integer points (n, dimensions). A node at radius r is split among points chosen so that each is beyond r / 2 of
    those before, the node's own point first; every point goes to the first that it is within r / 2 of."""
    n = len(points)
    order = np.arange(n)
    point, radius, first, last, begin, end = [0], [0.0], [0], [0], [0], [n]
    away = [np.sqrt(squared(points, points[0]).astype(float))] if n else [np.zeros(0)]
    k = 0
    while k < len(point):
        lo, hi, d = begin[k], end[k], away[k]
        away[k] = None
        radius[k] = float(d.max()) if hi > lo else 0.0
        first[k] = last[k] = len(point)
        if hi - lo > 1:
            own, reach = order[lo:hi].copy(), radius[k] / 2
            at = lo
            while len(own):  # the first of these is the node's own point, then the first not covered
                centre = point[k] if at == lo else own[0]
                near = d <= reach if at == lo else None
                if near is None:
                    d = np.sqrt(squared(points[own], points[centre]).astype(float))
                    near = d <= reach
                inside = own[near]
                order[at : at + len(inside)] = inside
                point.append(int(centre))
                radius.append(0.0)
                first.append(0)
                last.append(0)
                begin.append(at)
                end.append(at + len(inside))
                away.append(d[near])
                at += len(inside)
                own, d = own[~near], None
            last[k] = len(point)
        k += 1
    return Tree(*(np.array(x) for x in (point, radius, first, last, begin, end, order)))


def _expanded(node: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Each node's children, or itself if it is a leaf: (index into node, node below)."""
    n = tree.last[node] - tree.first[node]
    size = np.maximum(n, 1)
    at = np.repeat(np.arange(len(node)), size)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    return at, np.where(n[at] > 0, tree.first[node[at]] + nth, node[at])


def nearest(points: np.ndarray, tree: Tree, centres: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each point the row of the nearest centre (the first of equally near ones) and the squared distance."""
    best, who = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
    q, r = np.zeros(min(1, len(points)), np.int64), np.zeros(min(1, len(points)), np.int64)
    while len(q):
        d = np.concatenate([squared(points[tree.point[q[k : k + PAIRS]]], centres[over.point[r[k : k + PAIRS]]]) for k in range(0, len(q), PAIRS)])
        leaf = (tree.first[q] == tree.last[q]) & (over.first[r] == over.last[r])
        # Exact among leaves: by distance, then by the centre's number.
        a, b, c = tree.point[q[leaf]], over.point[r[leaf]], d[leaf]
        by = np.lexsort((b, c, a))
        a, b, c = a[by], b[by], c[by]
        one = np.ones(len(a), bool)
        one[1:] = a[1:] != a[:-1]
        a, b, c = a[one], b[one], c[one]
        better = (c < best[a]) | (c == best[a]) & (b < who[a])
        best[a[better]], who[a[better]] = c[better], b[better]
        # What a node's farthest point can have at most to one centre, and what a pair's points have at least.
        root = np.sqrt(d.astype(float))
        most = np.full(len(tree.point), np.inf)
        np.minimum.at(most, q, root + tree.radius[q])
        keep = ~leaf & (root - tree.radius[q] - over.radius[r] <= most[q] * (1 + 1e-9) + 1e-6)
        at, q = _expanded(q[keep], tree)
        at, r = _expanded(r[keep][at], over)
        q = q[at]
    return who, best


def _integers(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(x, "<i8")


def build_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, v (array of longs) -> a row for each block: ids, distinct points, each vector's point, and the points' cover tree."""
    import pyarrow as pa

    kind = vectors.schema["id"].dataType.simpleString()
    names = ["points", "of", *Tree._fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(rows), block):
                part = rows.slice(k, block).combine_chunks()
                ids, v = part.column(0).combine_chunks(), part.column(1).combine_chunks()
                every = v.flatten().to_numpy().reshape(len(v), -1)
                points, of = np.unique(every, axis=0, return_inverse=True)
                tree = cover_tree(points)
                cells = [points.astype("<i8"), of.astype("<i8"), *(x.astype("<f8" if x.dtype == float else "<i8") for x in tree)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["ids", *names])

        for batch in batches:
            held.append(batch)
            while (rows := sum(map(len, held))) >= block:
                whole = pa.Table.from_batches(held)
                yield from flush(whole.slice(0, rows - rows % block))
                held = whole.slice(rows - rows % block).to_batches()
        if sum(map(len, held)):
            yield from flush(pa.Table.from_batches(held))

    return vectors.select("id", "v").mapInArrow(run, f"ids array<{kind}>, {', '.join(f'{n} binary' for n in names)}")


def _walked(batch, dims: int, centres: np.ndarray, over: Tree):
    """Of each block in a batch: ids, points, each vector's point, the points' nearest centres and squared distances."""
    for k in range(len(batch)):
        points, of, point, radius, *rest = (batch.column(j)[k].as_buffer() for j in range(1, 10))
        tree = Tree(_integers(point), np.frombuffer(radius, "<f8"), *map(_integers, rest))
        points = _integers(points).reshape(-1, dims)
        yield batch.column(0)[k].values, points, _integers(of), *nearest(points, tree, centres, over)


def _distinct_centres(centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct centres in the order of their least numbers, and these; an equal centre with a greater number is never nearest."""
    seen = {tuple(c): k for k, c in reversed(list(enumerate(centres)))}
    numbers = sorted(seen.values())
    return np.array([centres[k] for k in numbers], np.int64), np.array(numbers, np.int64)


def _sums(blocks: DataFrame, centres: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each centre that has vectors: their number and the sum of each component. As many rows as centres are collected."""
    import pyarrow as pa

    points_of, numbers = _distinct_centres(centres)
    dims, over = len(centres[0]), cover_tree(points_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(numbers), np.int64), np.zeros((len(numbers), dims), np.int64)
        for batch in batches:
            for _, points, of, who, _ in _walked(batch, dims, points_of, over):
                weight = np.bincount(of, minlength=len(points))
                n += np.bincount(who, weight, len(numbers)).astype(np.int64)
                np.add.at(total, who, points * weight[:, None])
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (dims + 1)), pa.array(np.column_stack([n, total])[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(numbers[some], pa.int64()), lists], ["c", "s"])

    parts = blocks.mapInArrow(run, "c long, s array<long>").select("c", F.posexplode("s").alias("k", "s"))
    by = parts.groupBy("c", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {r.c: (int(r.s[0].s), [int(x.s) for x in r.s[1:]]) for r in by.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s")).collect()}


def dual_tree_lloyd(vectors: DataFrame, k: int, rounds: int, salt: str = "2", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """id, v (arrays of equally many longs) -> (id, cluster, distance), and the final centroids.

    Centroids start as the k vectors with the smallest sha256 of `salt:id`, in that order (ties, as of repeated ids, by the
    components; null ids last); with fewer vectors there are fewer centroids. Each round assigns every vector to the nearest
    centroid, the smallest number of equally near ones, and moves every centroid that has vectors to the floor of their mean.
    Without vectors the result is empty and there are no centroids. The result is a table in the shared folder.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    centres = [list(r.v) for r in vectors.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()]
    if not centres:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    blocks = stored(build_blocks(vectors, block))
    for _ in range(rounds):
        for c, (n, total) in _sums(blocks, centres).items():
            centres[c] = [x // n for x in total]
    points_of, numbers = _distinct_centres(centres)
    dims, over = len(centres[0]), cover_tree(points_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, of, who, best in _walked(batch, dims, points_of, over):
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[who][of].astype(np.int32)), pa.array(best[of])], ["id", "cluster", "distance"])

    out = stored(blocks.mapInArrow(run, f"id {kind}, cluster int, distance long"))
    dropped(blocks)
    return out, centres


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and v of rows with exactly `dims` components, none null or not finite: floor(scale * component) as longs, held to MOST either way."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.filter((F.size(vector_col) == dims) & finite)
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(x.cast("double") * scale).cast("double")))
    # Floor of a double beyond a long's range stops at that range, so the bounds hold.
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: held(x).cast("long")).alias("v"))


def cluster_report(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: see `dual_tree_lloyd` and `whole_vectors`.

    Rows with a null vector, another length, or a null or infinite component have no row. Repeated rows and ids are vectors
    of their own. Components beyond 2^19 are held to it, as distances wouldn't fit in a long; sums that wouldn't are an error.
    """
    spark: SparkSession = embeddings.sparkSession
    found, centres = dual_tree_lloyd(whole_vectors(embeddings, "vec_id", "embedding", dims, scale), k, rounds)
    digests = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centres)]
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    rows = [(n, sums.get(n, 0), sum(sums.values()), digest) for n, digest in digests]
    by = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(by, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """The same for DuckDB, comparing every vector with every centroid; ids must not repeat."""
    near = """, a{n} AS MATERIALIZED (
  SELECT i, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT e.i, e.v, z.c, CAST(list_sum(list_transform(list_zip(e.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM e CROSS JOIN c{n} z) GROUP BY i
)"""
    move = """, c{next} AS MATERIALIZED (
  SELECT c, coalesce(n.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % w) + w) % w) // w AS BIGINT) ORDER BY k) AS v
    FROM (SELECT m.c AS c, k, sum(v[k]) AS s, count(*) AS w FROM a{n}, range(1, {dims} + 1) r(k) GROUP BY 1, 2) GROUP BY c
  ) n USING (c)
)"""
    steps = "".join(near.format(n=r) + move.format(n=r, next=r + 1, dims=dims) for r in range(rounds)) + near.format(n=rounds)
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id AS i, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS c, v FROM (SELECT sha256('2:' || i) AS h, v FROM e ORDER BY h LIMIT {k})
){steps}
SELECT i AS vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} z ON z.c = m.c"""
