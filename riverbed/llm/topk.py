"""Exact top-k inner-product search: a ball tree on every shard, searched by branch and bound.

Vectors are dealt to the nearest of some pivots, and large cells to several shards, so that a shard is a bounded number of vectors inside
one ball. A query first searches the cell of highest upper bound, query . centre + |query| * radius; the k-th score found there goes with
it to those other cells only whose bound reaches it. Inside a shard the same test opens the balls of its tree, by falling bound, and what
is found raises the k-th score for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, share, table


@dataclass(frozen=True)
class Params:
    k: int = 5
    #: Vectors of a shard and queries of a part, on average; and pivots at most.
    shard: int = 32_768
    part: int = 16_384
    pivots: int = 4096
    leaf: int = 128
    scale: int = 256


class BallTree:
    """Balls over rows of x: the longest spread is halved until a ball holds leaf rows at most."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        own = self.x[rows].astype(np.float64)
        centre = own.mean(0)
        away = own - centre
        radius = float(np.sqrt((away * away).sum(1).max())) if len(rows) else 0.0
        if len(rows) <= leaf or radius == 0 and len(rows) <= 4 * leaf:
            return centre, radius, rows, None
        far = away[int((away * away).sum(1).argmax())]
        side = np.argsort(away @ far, kind="stable")
        half = len(rows) // 2
        return centre, radius, None, (self._build(np.sort(rows[side[:half]]), leaf), self._build(np.sort(rows[side[half:]]), leaf))


class Search:
    """The best k (score, id) for each of some queries, over any number of trees. bound: scores below it are of no use."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray):
        self.q, self.ids, self.k = q, ids, k
        self.flat = q.astype(np.float64)
        self.norm = np.sqrt((self.flat * self.flat).sum(1))
        self.low = bound.astype(np.float64)
        # exact products: in doubles while sums stay below 2**53, else in Python's integers
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.big: list[list[tuple[int, int]]] | None = None

    def run(self, tree: BallTree) -> None:
        top = (np.abs(self.flat).max(initial=0) * np.abs(tree.x.astype(np.float64)).max(initial=0)) * max(1, tree.x.shape[1])
        if top >= 2**53:
            self._all(tree)
        else:
            self._visit(tree, tree.root, np.arange(len(self.ids)))

    def _visit(self, tree: BallTree, node, active: np.ndarray) -> None:
        centre, radius, rows, children = node
        bound = self.flat[active] @ centre + self.norm[active] * radius
        active = active[bound * (1 + 1e-12 * np.sign(bound)) + 1e-6 >= self.low[active]]
        if not active.size:
            return
        if children is None:
            self._leaf(tree, rows, active)
            return
        means = [float((self.flat[active] @ c[0] + self.norm[active] * c[1]).mean()) for c in children]
        for c in sorted(range(2), key=lambda j: -means[j]):
            self._visit(tree, children[c], active)

    def _leaf(self, tree: BallTree, rows: np.ndarray, active: np.ndarray) -> None:
        ids = tree.ids[rows]
        s = self.flat[active] @ tree.x[rows].astype(np.float64).T
        s[ids[None] == self.ids[active][:, None]] = -np.inf
        good = (s >= self.low[active][:, None]).any(1)
        active, s = active[good], s[good]
        if not active.size:
            return
        score = np.concatenate((self.score[active], s), axis=1)
        found = np.concatenate((self.found[active], np.broadcast_to(ids, s.shape)), axis=1)
        found[np.isneginf(score)] = np.iinfo(np.int64).max
        best = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[active], self.found[active] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        self.low[active] = np.maximum(self.low[active], self.score[active, -1])

    def _all(self, tree: BallTree) -> None:
        """Without balls, for components so large that doubles are not exact."""
        q, x = [[int(v) for v in r] for r in self.flat], [[int(v) for v in r] for r in tree.x]
        self.big = self.big or [[] for _ in q]
        for j, row in enumerate(q):
            mine = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(row, y, strict=True)))), int(i)) for y, i in zip(x, tree.ids, strict=True) if i != self.ids[j]]
            self.big[j] = sorted(self.big[j] + mine)[: self.k]

    def rows(self):
        """(query, id, score) of what was found."""
        if self.big is not None:
            for j, found in enumerate(self.big):
                more = [(-int(s), int(i)) for s, i in zip(self.score[j], self.found[j], strict=True) if np.isfinite(s)]
                for s, i in sorted(found + more)[: self.k]:
                    yield j, i, -s
            return
        j, at = np.nonzero(np.isfinite(self.score))
        yield from zip(j.tolist(), self.found[j, at].tolist(), self.score[j, at].astype(np.int64).tolist(), strict=True)


def matrix(tbl: pa.Table, name: str, dim: int) -> np.ndarray:
    flat = tbl.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((tbl.num_rows, 0))


def search_cell(p: Params):
    """For a shard's vectors and a part of the queries: the best of the shard for each query that reach its bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            tree = BallTree(matrix(left, "v", dim), left.column("vec_id").to_numpy(), p.leaf)
            bound = right.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            s = Search(matrix(right, "v", dim), right.column("vec_id").to_numpy(), p.k, np.where(np.isnan(bound), -np.inf, bound))
            s.run(tree)
            ids, q = right.column("vec_id").to_pylist(), right.column("q").to_pylist()
            for j, i, score in s.rows():
                for x, y in zip(out, (q[j], ids[j], i, score), strict=True):
                    x.append(y)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("q", "query_id", "vec_id", "score"), out, strict=True)})

    return run


def unpacked(column) -> np.ndarray:
    """Vectors of one length out of a list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def dealt(v: DataFrame, n: int, p: Params) -> tuple[DataFrame, dict[int, tuple]]:
    """v with cell (its nearest pivot) and part, and by length of vectors the cells' centres, radii and numbers of vectors.

    Pivots are as many vectors, chosen by a hash, as there would be shards, p.pivots at most.
    """
    wanted = min(p.pivots, -(-n // p.shard))
    chosen = v.where(share("vec_id", 1.5 * wanted / max(1, n))).limit(2 * p.pivots).select("dim", "v").collect() if wanted > 1 else []
    pivots: dict[int, np.ndarray] = {}
    for r in sorted(chosen):
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {k: np.unique(np.array(x, np.float64).reshape(len(x), -1), axis=0) for k, x in pivots.items()}
    shared = v.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        known = shared.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = unpacked(batch.column(2).take(pa.array(rows)))
                c = known.get(int(dim), np.zeros((1, int(dim))))
                for k in range(0, rows.size, 2048):
                    y = x[k : k + 2048]
                    near = ((c * c).sum(1)[None] - 2 * (y @ c.T)).argmin(1) if dim else np.zeros(len(y), np.int64)
                    cell[rows[k : k + 2048]], away[rows[k : k + 2048]] = near, np.sqrt(((y - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], ["vec_id", "dim", "v", "cell", "away"])

    placed = materialize(v.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, v array<double>, cell int, away double"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / p.shard).cast("int")
    out = placed.join(sizes.select("dim", "cell", parts.alias("parts")), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").cast("int"))
    balls: dict[int, tuple] = {}
    rows = sorted(map(tuple, sizes.collect()))
    for dim in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == dim]
        c = pivots.get(dim, np.zeros((1, dim)))
        balls[dim] = np.array([r[1] for r in own], np.int32), c[[r[1] for r in own]], np.array([r[2] for r in own]), np.array([-(-r[3] // p.shard) for r in own])
    return out.select("vec_id", "dim", "v", "cell", "shard"), balls


def routed(asked: DataFrame, balls: dict[int, tuple], first: bool) -> DataFrame:
    """A row for each query (q, vec_id, dim, v, bound) and shard to search: with first, those of the cell of highest upper bound; else those of
    all other cells whose upper bound reaches the query's."""
    shared = asked.sparkSession.sparkContext.broadcast(balls)

    def run(batches):
        for batch in batches:
            dims, bound = batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                cells, centres, radii, parts = shared.value[int(dim)]
                for k in range(0, rows.size, 512):
                    at = rows[k : k + 512]
                    x = unpacked(batch.column(3).take(pa.array(at)))
                    norm, size = np.sqrt((x * x).sum(1)), np.sqrt((centres * centres).sum(1)) + radii
                    top = x @ centres.T + norm[:, None] * radii[None] + 1e-9 * norm[:, None] * size[None] + 1e-6 if dim else np.zeros((at.size, len(cells)))
                    home = top.argmax(1)
                    go = np.zeros(top.shape, bool) if first else ~(top < bound[at][:, None])
                    go[np.arange(at.size), home] = first
                    i, j = np.nonzero(go)
                    i, j = np.repeat(i, parts[j]), np.repeat(j, parts[j])
                    shard = np.arange(j.size) - np.maximum.accumulate(np.where(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])), np.arange(j.size), 0)) if j.size else j
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at[i])) for c in batch.columns), pa.array(cells[j]), pa.array(shard.astype(np.int32))], [*batch.schema.names, "cell", "shard"])

    return asked.select("q", "vec_id", "dim", "v", "bound").mapInArrow(run, "q long, vec_id long, dim int, v array<double>, bound double, cell int, shard int")


def top_k(vectors: DataFrame, is_query, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of highest integer inner product, ties to the smaller vec_id.

    Vectors become floor(scale * x). is_query(column vec_id) says which rows are queries; a query's own vec_id is no candidate for it.
    Rows with a null vec_id or vector, or a null or non-finite component, take no part. Rows that repeat a vec_id and its vector are one
    query, but as candidates each counts. Vectors of other lengths are not compared. Scores beyond 64 bits are clamped to them. Fewer
    than k candidates give fewer rows; an empty table gives an empty table; other columns are not looked at.
    """
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & sound)
    keys = ("dim", "cell", "shard", "part")

    def cells(data: DataFrame, ask: DataFrame) -> DataFrame:
        """Searches of all (shard, query) pairs: a shard's queries come in parts, and its vectors once for each part."""
        parts = ask.groupBy("dim", "cell", "shard").agg(F.ceil(F.count("*") / p.part).cast("int").alias("parts"))
        ask = ask.join(parts, ["dim", "cell", "shard"]).withColumn("part", F.pmod(F.xxhash64("q", F.lit(2)), "parts").cast("int")).drop("parts")
        data = data.join(parts, ["dim", "cell", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        one, two = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (data, ask))
        return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(search_cell(p), "q long, query_id long, vec_id long, score long")

    with scratch() as keep:
        v = materialize(v.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x * p.scale).cast("double")).alias("v")), "vectors")
        data, balls = dealt(v, v.count(), p)
        asked = v.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"]).withColumn("q", F.xxhash64("vec_id", "v")).withColumn("bound", F.lit(None).cast("double"))
        asked = materialize(asked, "queries")
        found = materialize(cells(data, materialize(routed(asked, balls, True), "homes")), "first")
        if any(len(b[0]) > 1 for b in balls.values()):
            # the best k of each shard are there, so the k-th best of all is what bounds the rest
            order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == p.k).select("q", F.col("score").cast("double").alias("low"))
            rest = routed(asked.drop("bound").join(kth, "q", "left").withColumnRenamed("low", "bound"), balls, False)
            found = found.unionByName(cells(data, materialize(rest, "others")))
        order = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
        return keep(materialize(ranked.select("query_id", "rank", "vec_id", "score"), "top"))


def op7_ball_tree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for each whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
