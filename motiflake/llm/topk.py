"""Exact top-k search by inner product: KD-trees per shard.

Vectors go to cells: a KD split fitted on a bounded sample, each cut at the median of the widest dimension. A cell is one
shard, or several by hash if it is large. A shard's tree splits the same way and keeps tight boxes. A query visits nodes
best first, by the largest inner product that their box allows, until no box can beat its kth score so far. That score is
propagated: each query first searches its own shard, whose pass also gives the boxes of all cells, and then only the shards
of cells whose box can beat the kth score found.

Shards stream: a task sorts each shard's vectors before its queries, builds the tree when the first query comes and
answers one batch of queries after another, so neither side is ever held whole. Queries are dealt to shards as rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, share_code, written

#: Vectors of a shard at most, about, and of a leaf.
SHARD_ROWS, LEAF = 16_384, 128
#: Vectors of a cell at least, about; cells at most; sampled vectors for each cell.
CELL_ROWS, CELLS, SAMPLE = 512, 4_096, 64
#: A row without id has this one inside, so it comes last among equals.
NO_ID = 2**63 - 1


class Tree:
    """points: rows of integers, as float64 where all products are exact there, else as Python integers."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, numbers: np.ndarray | None = None):
        order, lo, hi, least, spans, children = np.argsort(ids, kind="stable"), [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = points[order[a:b]]
            if parent >= 0:
                children[parent][side] = len(lo)
            lo.append(rows.min(axis=0))
            hi.append(rows.max(axis=0))
            least.append(int(ids[order[a:b]].min()))
            spans.append((a, b))
            children.append([-1, -1])
            if b - a > leaf and points.shape[1]:
                wide = int((hi[-1] - lo[-1]).argmax())
                mid = (b - a) // 2
                if points.dtype == object:
                    order[a:b] = order[a:b][np.argsort(rows[:, wide], kind="stable")]
                else:
                    order[a:b] = order[a:b][np.argpartition(rows[:, wide], mid)]
                todo += [(a, a + mid, len(lo) - 1, 0), (a + mid, b, len(lo) - 1, 1)]
        self.lo, self.hi, self.least, self.spans, self.children = np.array(lo), np.array(hi), least, spans, children
        self.ids, self.points, self.rows = ids[order], points[order], (ids if numbers is None else numbers)[order]

    def search(self, own: int, q: np.ndarray, bounds: np.ndarray, k: int, kth: tuple[int, int] | None) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, of rows other than `own`; only those at least as good as `kth`, if given.
        bounds: of every node, the largest inner product that its box allows."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        worst = (kth[0], -kth[1]) if kth else None
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if worst is not None and (-bound, -least) < worst:
                break
            left, right = self.children[node]
            if left >= 0:
                for c in (left, right):
                    if worst is None or (bounds[c], -self.least[c]) >= worst:
                        heapq.heappush(heap, (-bounds[c], self.least[c], c))
                continue
            a, b = self.spans[node]
            scores = self.points[a:b] @ q
            for i in np.flatnonzero(scores >= worst[0]) if worst is not None else range(b - a):
                item = (int(scores[i]), -int(self.ids[a + i]))
                if self.rows[a + i] == own or (worst is not None and item < worst):
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                else:
                    heapq.heappushpop(best, item)
                if len(best) == k and (worst is None or best[0] > worst):
                    worst = best[0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    return np.array([[*v, *[0] * (width - len(v))] for v in lists], dtype=object).reshape(len(lists), width)


def _floats(column: pa.Array) -> np.ndarray:
    """The lists of a batch as rows, the shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _fit(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, child below the cut, other child) of a KD split into about `cells` cells; a child of -1 - c is
    cell c. Equal vectors aren't split, so there may be fewer."""
    nodes, made, todo = [], 0, [(np.arange(len(points)), cells, -1, 2)]
    while todo:
        at, n, parent, side = todo.pop()
        rows = points[at]
        wide = int((rows.max(axis=0) - rows.min(axis=0)).argmax()) if n > 1 and len(rows) > 1 and rows.shape[1] else -1
        cut = float(np.median(rows[:, wide])) if wide >= 0 else 0.0
        if wide >= 0 and not (rows[:, wide] < cut).any():
            cut = np.nextafter(cut, np.inf)
        low = rows[:, wide] < cut if wide >= 0 else np.zeros(0, bool)
        if not low.any() or low.all():
            me, made = -1 - made, made + 1
        else:
            me = len(nodes)
            nodes.append([wide, cut, 0, 0])
            todo += [(at[~low], n - n // 2, me, 3), (at[low], n // 2, me, 2)]
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(x) for x in nodes]


def _cells(nodes: list[tuple[int, float, int, int]]):
    """Rows (row, id, v) with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _floats(b.column(2)), np.full(b.num_rows, 0 if nodes else -1)
            for i, (wide, cut, low, high) in enumerate(nodes):  # a node comes before its children
                here = np.flatnonzero(at == i)
                value = x[here, wide] if wide < x.shape[1] else np.zeros(len(here))
                at[here] = np.where(value < cut, low, high)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(-1 - at, pa.int32())], [*b.schema.names, "cell"])

    return run


_SEEDED = [("row", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("tau_score", pa.int64()), ("tau_id", pa.int64()), ("cell", pa.int32()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]
_FOUND = [("row", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())]
_SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>"}


def _sql(names: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {_SQL_TYPES[t]}" for n, t in names)


def _search(k: int, seed: bool):
    """Rows by shard, its vectors (kind 0) before its queries (kind 1); a query's result rows, and from the first pass
    (`seed`) the box of each shard."""
    top, names = 2**63 - 1, _SEEDED if seed else _FOUND

    def answer(tree: Tree, rows, queries, taus):
        width = tree.points.shape[1]
        plain = _matrix([q[:width] for q in queries], width)  # components beyond all of the shard's vectors meet zeros
        most = max((abs(int(x)) for x in plain.flat), default=0) * max((abs(int(x)) for x in (tree.lo.min(initial=0), tree.hi.max(initial=0))), default=0) * max(1, width)
        exact = most < 2**52 and tree.points.dtype != object
        q = plain.astype(np.float64) if exact else plain
        if not exact and tree.points.dtype != object:
            tree.points, tree.lo, tree.hi = (x.astype(np.int64).astype(object) for x in (tree.points, tree.lo, tree.hi))
        bounds = np.maximum(q, 0) @ tree.hi.T + np.minimum(q, 0) @ tree.lo.T if width else np.zeros((len(queries), len(tree.spans)), dtype=tree.points.dtype)
        for i, own in enumerate(rows):
            yield tree.search(own, q[i], bounds[i], k, taus[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cell, points, tree, found = None, None, [], None, []

        def grown() -> Tree:
            lists = [v for *_, v in points]
            m = _matrix(lists, max(map(len, lists)))
            if max((abs(int(x)) for x in m.flat), default=0) < 2**26:
                m = m.astype(np.float64)
            return Tree(np.array([i for _, i, _ in points], dtype=np.int64), m, numbers=np.array([r for r, *_ in points], dtype=np.int64))

        def box() -> None:
            if seed and points:
                m = _matrix([v for *_, v in points], max(len(v) for *_, v in points))
                found.append((None, None, None, None, None, cell, m.min(axis=0).tolist(), m.max(axis=0).tolist()))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])

        for b in batches:
            at = 0
            shards, kinds, rows, ids, vs, ts, ti, cells = (c.to_pylist() for c in b.columns)
            while at < len(shards):
                if shards[at] != shard:
                    box()
                    shard, cell, points, tree = shards[at], cells[at], [], None
                end = at
                while end < len(shards) and shards[end] == shard and kinds[end] == kinds[at]:
                    end += 1
                if kinds[at] == 0:
                    points += zip(rows[at:end], ids[at:end], vs[at:end], strict=True)
                elif points:
                    tree = tree or grown()
                    taus = [None if s is None else (s, i) for s, i in zip(ts[at:end], ti[at:end], strict=True)]
                    for j, hits in zip(range(at, end), answer(tree, rows[at:end], vs[at:end], taus), strict=True):
                        if seed:
                            s, i = hits[-1] if len(hits) == k else (None, None)
                            found.append((rows[j], ids[j], vs[j], s if s is None or abs(s) <= top else None, i, cells[j], None, None))
                        else:
                            found += [(rows[j], ids[j], max(-top - 1, min(top, s)), i) for s, i in hits]
                at = end
            yield batch()
        box()
        yield batch()

    return run


def _routed(boxes: dict[int, tuple[np.ndarray, np.ndarray]], first: list[int], parts: list[int]):
    """Queries (row, id, v, tau_score, tau_id), once for each shard of the cells whose box allows their kth score."""
    cells = sorted(boxes)
    width = max((len(lo) for lo, _ in boxes.values()), default=0)
    lo, hi = (np.zeros((len(cells), width)) for _ in range(2))
    for c, cell in enumerate(cells):
        for side, found in zip((lo, hi), boxes[cell], strict=True):
            side[c, : len(found)] = found
    shards = [np.arange(first[c], first[c] + parts[c]) for c in cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            x = _floats(b.column(2))
            q = np.zeros((len(x), width))
            q[:, : x.shape[1]] = x[:, :width]
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            # What rounding may have taken from a bound is added.
            bound = up @ hi.T + down @ lo.T + 1e-12 * (up @ np.abs(hi).T - down @ np.abs(lo).T)
            tau = b.column(3).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            allowed = ~(bound < (tau - 1e-12 * np.abs(tau))[:, None])  # a missing kth score allows all
            for i in range(len(q)):
                to = np.concatenate([shards[c] for c in np.flatnonzero(allowed[i])] or [np.zeros(0, np.int64)])
                if len(to):
                    one = b.take(pa.array(np.full(len(to), i)))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *one.columns], ["shard", *b.schema.names])

    return run


def integers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of every component of every row, repeated ones too. Vectors that are null or hold
    null or non-finite components take no part; components beyond 64 bits are cut to their ends."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(c.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(x.isNotNull() & finite)
    return plain.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


class Index:
    """Vectors in cells, and the shards that cells are made of."""

    def __init__(self, spark: SparkSession, vectors: DataFrame):
        share_code(spark)
        self.spark = spark
        rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "v")
        rows = written(spark, rows, "vectors")
        n = rows.count()
        cells = max(1, min(CELLS, n // CELL_ROWS))
        rate = min(1.0, SAMPLE * cells / max(n, 1))
        sample = rows.filter(F.shiftrightunsigned(F.xxhash64("row"), 12) < int(rate * (1 << 52))) if rate < 1 else rows
        nodes = _fit(_floats(sample.select("v").toArrow().column(0)), cells) if cells > 1 else []
        self.rows = written(spark, rows.mapInArrow(_cells(nodes), "row long, id long, v array<long>, cell int"), "cells")
        counts = {r.cell: r["count"] for r in self.rows.groupBy("cell").count().collect()}
        self.parts = [-(-counts.get(c, 0) // SHARD_ROWS) for c in range(len(nodes) + 1)]
        self.first = np.concatenate([[0], np.cumsum(self.parts)]).astype(int).tolist()
        self.shards = max(1, self.first[-1])
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def home(self) -> Column:
        first, parts = (F.array(*map(F.lit, x)) for x in (self.first, self.parts))
        return (F.get(first, F.col("cell")) + F.pmod(F.xxhash64("row"), F.get(parts, F.col("cell")))).cast("long")

    def _dealt(self, queries: DataFrame) -> DataFrame:
        """Vectors and queries (shard, row, id, v, tau_score, tau_id) by shard, vectors first."""
        none = F.lit(None).cast("long")
        points = self.rows.select(self.home().alias("shard"), F.lit(0).alias("kind"), "row", "id", "v", none.alias("tau_score"), none.alias("tau_id"), "cell")
        asked = queries.select("shard", F.lit(1).alias("kind"), "row", "id", "v", "tau_score", "tau_id", F.lit(None).cast("int").alias("cell"))
        return points.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id", "row")

    def seeded(self, is_query: Column, k: int) -> DataFrame:
        """Queries after a search of their own shards, with the kth score found there, and boxes of all cells (kept here)."""
        none = F.lit(None).cast("long")
        own = self.rows.withColumn("vec_id", F.when(F.col("id") < NO_ID, F.col("id"))).filter(is_query)
        own = own.select(self.home().alias("shard"), "row", "id", "v", none.alias("tau_score"), none.alias("tau_id"))
        found = written(self.spark, self._dealt(own).mapInArrow(_search(k, True), _sql(_SEEDED)), "seeded")
        sides = found.filter("row is null").select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "x")).groupBy("cell", "at").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.count("*").alias("n"))
        whole = {r.cell: r["count"] for r in found.filter("row is null").groupBy("cell").count().collect()}
        self.boxes = {c: (np.zeros(0), np.zeros(0)) for c in whole}
        by: dict[int, list] = {}
        for r in sides.collect():
            by.setdefault(r.cell, []).append(r)
        for c, rs in by.items():
            rs.sort(key=lambda r: r["at"])
            # Dimensions that some shard of the cell lacks are zero there.
            lo, hi = ([(f(x, 0) if r.n < whole[c] else x) for r in rs for x in [r[name]]] for name, f in (("lo", min), ("hi", max)))
            self.boxes[c] = np.array(lo, dtype=np.float64), np.array(hi, dtype=np.float64)
        return found.filter("row is not null").select("row", "id", "v", "tau_score", "tau_id")

    def routed(self, seeded: DataFrame) -> DataFrame:
        """Queries by the shards that may hold a better one than their kth: shard, row, id, v, tau_score, tau_id."""
        return seeded.mapInArrow(_routed(self.boxes, self.first, self.parts), "shard long, row long, id long, v array<long>, tau_score long, tau_id long")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows of each query row, ties to the smaller vec_id.

    vectors: vec_id and v, lists of integers; a shorter list counts as if zeros followed, an empty one scores 0. Every row
    is a candidate but for the query's own: rows that share an id, or repeat whole, are so many rows, and each that is a
    query has its own results. A row without id comes last among equals. Fewer than k others: all of them; no rows: none.
    Scores outside 64 bits are cut to its ends. The id 2^63 - 1 is taken for none."""
    index = Index(spark, vectors)
    seeded = index.seeded(is_query, k)
    found = index._dealt(index.routed(seeded)).mapInArrow(_search(k, False), _sql(_FOUND))
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select(known("query_id"), "rank", known("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 5 best of every row whose vec_id is divisible by 50; nulls, repeats and empty tables as in top_k() and
    integers()."""
    return top_k(spark, integers(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) <= 5
"""
