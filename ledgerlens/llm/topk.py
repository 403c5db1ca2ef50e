"""Exact top-k inner-product search by dual cover trees.

The queries of a block and the vectors of a batch are indexed together, each by a cover tree: a node has a centre
and a covering radius, its children's centres lie apart by more than the scale of their level. A pair of nodes is
skipped if no query under the one can meet a vector under the other with a better score than the worst k-th score
of that query group: the inner product is at most that of the centres, plus what the radii allow. Nodes whose points are
spread too evenly to be covered by few children stay leaves, whose scores are matrix products, a tile of bounded size at
a time, in single precision where that is exact. Vectors stay where they are read; the queries go to them in blocks of
bounded size, and only k rows a query and task are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, staged

#: Bytes of query vectors and their results that an executor's task holds at once; more queries take more passes.
BLOCK_BYTES = 16_000_000
LEAF, FAN, BASE = 128, 24, 1.6
SCALE = 1024
#: Above this an inner product may not be exact in a double; such vectors are scored by integers of any size.
EXACT = 2.0**53
#: Where norms multiply to less, all sums of an inner product are integers below 2**24, exact in single precision.
EXACT_SINGLE = 1.6e7
#: Scores are made and looked through for at most so many queries and vectors at a time.
TILE_QUERIES, TILE_ROWS = 512, 1024
#: Vectors that are gathered from batches before they are searched: at most so many, of about so many bytes.
GATHER_ROWS, GATHER_BYTES = 8192, 8_000_000
#: Vectors that a task reads, unless that leaves cores idle: each task shuffles k rows a query.
TASK_ROWS = 1_000_000
#: Points that tell whether larger nodes are worth covering.
PROBE = 512


@dataclass
class Node:
    """Points are index[lo:hi] of the tree's order."""

    centre: object
    norm: float
    radius: float
    points: object
    children: list = field(default_factory=list)


def cover_tree(x, points=None, scale: float | None = None) -> Node:
    """The cover tree over rows of x."""
    import numpy as np

    points = np.arange(len(x)) if points is None else points
    centre = x[points[0]]
    far = _apart(x, points, centre)
    radius = float(far.max())
    node = Node(centre, float(np.sqrt((centre**2).sum())), radius, points)
    if len(points) <= LEAF or radius == 0:
        return node
    scale = radius / BASE if scale is None else min(scale / BASE, radius / BASE)
    if len(points) > 4 * PROBE:
        some = slice(None, None, len(points) // PROBE)
        if _groups(x, points[some], far[some], scale) is None:
            return node
    groups = _groups(x, points, far, scale)
    node.children = [cover_tree(x, g, scale) for g in groups or []]
    return node


def _apart(x, points, centre):
    import numpy as np

    d = x[points] - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _groups(x, points, near, scale: float) -> list | None:
    """Groups of points within scale of their first; None if these are over FAN. near: the distances from the first point."""
    groups = []
    while len(points):
        inside = near <= scale
        groups.append(points[inside])
        points = points[~inside]
        if len(groups) > FAN:
            return None
        if len(points):
            near = _apart(x, points, x[points[0]])
    return groups


class Vectors:
    """Vectors of one width with their ids. exact: their components as long."""

    def __init__(self, ids, exact):
        import numpy as np

        self.ids, self.exact, self.double, self.single = ids, exact, exact.astype(np.float64), exact.astype(np.float32)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.double, self.double))


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.tile = np.empty(TILE_QUERIES * TILE_ROWS)

    def among(self, rows, own, scores, ids) -> tuple:
        """(query, score, id) of the scores that may be among the best, few more, of one row per query of rows and one
        column per id; own: the ids of the queries."""
        import numpy as np

        least, width = self.score[rows, -1].astype(scores.dtype), scores.shape[1]
        reach = np.flatnonzero(scores.max(axis=1) >= least)
        rows, own, scores, least = rows[reach], own[reach], scores[reach], least[reach]
        some = scores >= least[:, None]
        if np.count_nonzero(some) > some.size // 16:  # so many hold k others' scores for sure, own and repeated ids apart
            take = (self.k + 1) * int(np.unique(ids, return_counts=True)[1].max())
            if take < width:
                kth = np.partition(scores, width - take, axis=1)[:, width - take]
                some = scores >= np.maximum(kth, least)[:, None]
        at, column = np.divmod(np.flatnonzero(some), width)
        s, i, r = scores[at, column].astype(np.float64), ids[column], rows[at]
        fit = (i != own[at]) & ((s > self.score[r, -1]) | (i < self.id[r, -1]))
        return r[fit], s[fit], i[fit]

    def add(self, found: list[tuple]) -> None:
        """found: as of among."""
        import numpy as np

        r, s, i = (np.concatenate(c) for c in zip(*found))
        if not len(r):
            return
        rows = np.unique(r)
        r = np.concatenate([np.repeat(rows, self.k), r])
        s, i = np.concatenate([self.score[rows].ravel(), s]), np.concatenate([self.id[rows].ravel(), i])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        new = np.ones(len(r), bool)  # rows that repeat an id and a score take one place
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        r, s, i = r[new], s[new], i[new]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        top = nth < self.k
        self.score[rows], self.id[rows] = -np.inf, np.iinfo(np.int64).max
        self.score[r[top], nth[top]], self.id[r[top], nth[top]] = s[top], i[top]


def scan(q: Vectors, a, x: Vectors, b, best: Best) -> None:
    """Adds to ``best`` what the vectors x[b] have for the queries q[a], a tile at a time."""
    import numpy as np

    for lo in range(0, len(a), TILE_QUERIES):
        rows = a[lo : lo + TILE_QUERIES]
        own, norm = q.ids[rows], q.norm[rows].max()
        single, double, found, n = q.single[rows], None, [], 0
        for at in range(0, len(b), TILE_ROWS):
            columns = b[at : at + TILE_ROWS]
            if norm * x.norm[columns].max() < EXACT_SINGLE:
                left, right = single, x.single[columns]
            else:
                left, right = q.double[rows] if double is None else double, x.double[columns]
                double = left
            # memory that is asked for anew costs more than the product
            scores = best.tile.view(left.dtype)[: len(rows) * len(columns)].reshape(len(rows), len(columns))
            found.append(best.among(rows, own, np.matmul(left, right.T, out=scores), x.ids[columns]))
            n += len(found[-1][0])
            if n > best.k * len(rows):
                best.add(found)
                found, n = [], 0
        if n:
            best.add(found)


def dual_search(q: Vectors, q_tree: Node, x: Vectors, best: Best) -> None:
    """Adds to ``best`` what the vectors x have for the queries q."""

    def bound(a: Node, b: Node) -> float:
        most = float(a.centre @ b.centre) + a.radius * b.norm + (a.norm + a.radius) * b.radius
        return most + 1e-9 * abs(most) + 1e-6

    tree = cover_tree(x.double)
    stack = [(bound(q_tree, tree), q_tree, tree)]
    while stack:
        most, a, b = stack.pop()
        if most < best.score[a.points, -1].min():
            continue
        if not a.children and not b.children:
            scan(q, a.points, x, b.points, best)
        elif a.children and (not b.children or a.radius >= b.radius):
            stack.extend((bound(c, b), c, b) for c in a.children)
        else:  # the most promising node is searched first, so it lies on top
            stack.extend(sorted(((bound(a, c), a, c) for c in b.children), key=lambda t: t[0]))


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): floor(SCALE * component) as long; rows without an id or with a null or non-finite component are left out."""
    ok = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return table.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def components(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) as read, for ``_by_width``, which does in Python what ``vectors`` takes a function call a component for."""
    v = F.col(vec_col) if dict(table.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())


def top_k(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by ``every``, against all rows but those of
    the query's own id; ties to the smaller id.

    A row is known by its id: rows that repeat an id and its vector count once. Vectors are compared only with those
    of as many components. Scores beyond a long's range saturate. No valid vector or no other row: no rows.
    """
    spark = table.sparkSession
    rows = components(table, id_col, vec_col)
    asks = F.col("id") % every == 0
    total, n, width = rows.agg(F.count("*"), F.count_if(asks), F.coalesce(F.max(F.when(asks, F.size("v"))), F.lit(1))).first()
    blocks = max(1, math.ceil(n * (width + 1 + 2 * k) * 8 / BLOCK_BYTES))
    tasks = max(math.ceil(total / TASK_ROWS), math.ceil(2 * spark.sparkContext.defaultParallelism / blocks))
    asked = vectors(table.filter(F.col(id_col).cast("long") % every == 0), id_col, vec_col).distinct().withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    if blocks > 1:
        asked = staged(asked, "top_k-queries")
    result = None
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_by_width(asked.filter(F.col("block") == block).select("id", "v").toArrow().to_batches()))
        found = map_batches(rows.coalesce(tasks), _searcher(held, k), "query_id long, vec_id long, score long")
        result = found if result is None else result.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    # dealt by query once, for both what follows
    result = result.repartition("query_id").distinct()
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_width(batches) -> dict[int, tuple]:
    """(ids, one row of components as long for each) by the vectors' width, of batches of ``vectors`` or ``components``."""
    import numpy as np
    import pyarrow as pa

    parts: dict[int, list] = {}
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        widths = np.asarray(lists.value_lengths())
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            own = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
            flat = own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(width))  # null: nan
            if flat.dtype.kind == "f":
                finite = np.isfinite(flat).all(axis=1)
                rows, flat = rows[finite], _floors(flat[finite])
            parts.setdefault(int(width), []).append((ids[rows], flat))
    return {w: tuple(np.concatenate(c) for c in zip(*p)) for w, p in parts.items()}


def _floors(x):
    """floor(SCALE * x) as long; beyond its range the nearest long, as in Spark."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    above = y >= 2.0**63
    out = np.where(above, 0, y).clip(min=-(2.0**63)).astype(np.int64)
    out[above] = np.iinfo(np.int64).max
    return out


def _gathered(batches):
    """Lists of batches, each of about GATHER_ROWS rows or GATHER_BYTES."""
    held, n, size = [], 0, 0
    for batch in batches:
        if held and (n + batch.num_rows > GATHER_ROWS or size + batch.nbytes > GATHER_BYTES):
            yield held
            held, n, size = [], 0, 0
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
    if held:
        yield held


def _searcher(held, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        sets = {}
        for width, (ids, exact) in held.value.items():
            q = Vectors(ids, exact)
            sets[width] = (q, cover_tree(q.double), Best(len(ids), k))
        large: list[tuple[int, int, int]] = []
        most = 1 << 16
        for some in _gathered(batches):
            for width, (ids, exact) in _by_width(some).items():
                if width not in sets:
                    continue
                q, tree, best = sets[width]
                top = np.abs(exact.astype(np.float64)).max(axis=1, initial=0) * max(1, width) * np.abs(q.double).max(initial=0)
                fits = top < EXACT
                if fits.any():
                    dual_search(q, tree, Vectors(ids[fits], exact[fits]), best)
                for j in np.flatnonzero(~fits):
                    own = exact[j].tolist()
                    for i, v in zip(q.ids.tolist(), q.exact):
                        if i != ids[j]:
                            s = sum(a * b for a, b in zip(own, v.tolist()))
                            large.append((i, int(ids[j]), max(-(1 << 63), min((1 << 63) - 1, s))))
                    if len(large) > most:
                        large = _shorten(large, k)
                        most = max(1 << 16, 2 * len(large))
        large = _shorten(large, k)
        out = [[np.array([r[c] for r in large], np.int64) for c in range(3)]]
        for q, _, best in sets.values():
            at, nth = np.nonzero(best.score > -np.inf)
            out.append([q.ids[at], best.id[at, nth], best.score[at, nth].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def _shorten(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Of each query the k best."""
    kept: dict[int, int] = {}
    out = []
    for q, i, s in sorted(set(found), key=lambda r: (r[0], -r[2], r[1])):
        kept[q] = kept.get(q, 0) + 1
        if kept[q] <= k:
            out.append((q, i, s))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.id AS query_id, x.id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.id % 100 = 0 AND q.id <> x.id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
