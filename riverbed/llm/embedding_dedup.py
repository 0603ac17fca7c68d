"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. Neighbour lists start from windows of a few random sort orders and are refined by joining each node's
neighbours with one another: a neighbour's neighbour is likely a neighbour. Rounds end when one brings next to no new links. Vectors travel
as half-precision numbers, whose error is bounded, and every link is confirmed in doubles. Lists whose last entry still reaches the threshold are
saturated and grow, up to a length; nodes whose lists may be saturated are compared with all nodes of their label, in blocks, as their
lists have no room for all links. A sample is compared with all nodes to audit the recall of the others; where it falls short, refinement
goes on with new orders and longer lists, and where that is not enough either, all nodes of a label are compared. Edges at the threshold
give components, and inside a component all pairs are compared, in blocks, so that every node's number of links is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, share, table
from .graph import components, contract

EDGE = "a long, b long, sim double"


@dataclass(frozen=True)
class Params:
    threshold: float = 0.93
    #: Length of a neighbour list, and how long a saturated one may grow; nodes with k links or more are compared with all in any case.
    k: int = 8
    k_most: int = 32
    orders: int = 8
    window: int = 20
    #: Rounds end when one adds less than this share of new links, or after so many.
    settled: float = 0.001
    rounds: int = 8
    #: After the first round only neighbours within this of the threshold are joined: links are what is looked for, not the whole graph.
    near: float = 0.25
    #: Nodes that the audit compares with all (about), and the recall it asks for.
    audit: int = 1024
    recall: float = 0.999
    tries: int = 3
    #: Bytes of the vectors in a block: inside a component, and where nodes are compared with all of their label.
    block: int = 2 << 20
    seed: int = 17


#: Two unit vectors in half precision have an inner product within this of the exact one.
LOOSE = 0.002


def stack(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Vectors held as bytes; those in half precision as floats."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else column
    out = np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 1), kind)
    return out.astype(np.float32) if kind == np.float16 else out


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Distinct (label, vector): id (a 64-bit hash), label, dim, n (rows that hold it), x (unit vector, doubles as bytes) and h (halves)."""

    def run(batches):
        for batch in batches:
            x, h, dims = [], [], []
            for e in batch.column(3):
                v = np.array(e.as_py(), np.float64)
                v = v / np.abs(v).max()
                v = v / np.sqrt((v * v).sum())
                x.append(v.tobytes())
                h.append(v.astype(np.float16).tobytes())
                dims.append(v.size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(x, pa.binary()), pa.array(h, pa.binary())], ["id", "label", "n", "dim", "x", "h"])

    distinct = vectors.groupBy("label", "embedding").agg(F.count("*").alias("n"))
    return distinct.select(F.xxhash64("label", "embedding").alias("id"), "label", "n", "embedding").mapInArrow(run, "id long, label long, n long, dim int, x binary, h binary")


def windows(nodes: DataFrame, n: int, first: int, p: Params) -> DataFrame:
    """Edges from p.orders random sort orders, starting with number first: each node with the best of those that follow it.

    An order sorts by label, the signs of some random projections, and one projection more; nearly equal vectors mostly stand together.
    """
    bits = int(np.clip(np.ceil(np.log2(max(2, n / (8 * p.window)))), 1, 24))

    def keys(batches):
        for batch in batches:
            for t in range(first, first + p.orders):
                order = np.zeros(batch.num_rows)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = stack(batch.column(3).take(pa.array(rows)), np.float16)
                    y = x @ np.random.default_rng((p.seed, t, int(dim))).standard_normal((dim, bits + 1))
                    order[rows] = (y[:, :bits] > 0) @ (2.0 ** np.arange(bits)) + 0.5 + 0.49 * np.tanh(y[:, bits])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), batch.column(0), batch.column(1), batch.column(2), pa.array(order), batch.column(3)], ["t", "id", "label", "dim", "at", "h"])

    def run(batches):
        for batch in batches:
            n, w = batch.num_rows, p.window
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3)], 1)
            ids, values = batch.column(1).to_numpy(), batch.column(5).to_pylist()
            cut = np.append(np.append(0, np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), n)
            out = [[], [], []]
            for b, e in zip(cut[:-1], cut[1:], strict=True):
                x = stack(values[b:e], np.float16)
                for s in range(1, min(w, e - b - 1) + 1):
                    sim = (x[:-s] * x[s:]).sum(1)
                    for o, y in zip(out, (ids[b : e - s], ids[b + s : e], sim), strict=True):
                        o.append(y)
            if out[0]:
                a, b, sim = map(np.concatenate, out)
                sim = sim.astype(np.float64)
                order = np.lexsort((-sim, a))
                a, b, sim = a[order], b[order], sim[order]
                rank = np.arange(a.size) - np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), np.arange(a.size), 0))
                keep = rank < p.k
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(sim[keep])], ["a", "b", "sim"])

    dealt = nodes.select("id", "label", "dim", "h").mapInArrow(keys, "t int, id long, label long, dim int, at double, h binary")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionByRange(parts, "t", "label", "dim", "at").sortWithinPartitions("t", "label", "dim", "at", "id").mapInArrow(run, EDGE)


def best(edges: DataFrame, lengths: DataFrame | None, p: Params) -> DataFrame:
    """Neighbour lists a -> b: the k best of each node among edges in either direction, and k, longer where the list was saturated."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    both = both.join(lengths, "a", "left") if lengths is not None else both.withColumn("k", F.lit(None).cast("int"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = both.withColumn("k", F.coalesce("k", F.lit(p.k))).withColumn("r", F.row_number().over(order)).where("r <= k")
    return ranked.withColumn("last", F.min("sim").over(Window.partitionBy("a"))).withColumn("full", F.count("*").over(Window.partitionBy("a")) >= F.col("k"))


def refine(lists: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Edges between neighbours of one node that would enter a list: the neighbours-of-neighbours join, with vectors carried along."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            tbl = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, tbl]) if held is not None and held.num_rows else tbl
            mid = held.column("mid").to_numpy()
            end = int(np.searchsorted(mid, mid[-1])) if mid.size else 0  # the last group may go on
            yield from joined(held.slice(0, end))
            held = held.slice(end)
        if held is not None:
            yield from joined(held)

    def joined(tbl):
        if not tbl.num_rows:
            return
        mid, ids, low = (tbl.column(c).to_numpy() for c in ("mid", "id", "low"))
        x = tbl.column("h").to_pylist()
        cut = np.append(np.append(0, np.flatnonzero(mid[1:] != mid[:-1]) + 1), mid.size)
        out = [[], [], []]
        for b, e in zip(cut[:-1], cut[1:], strict=True):
            if e - b > 1:
                y = stack(x[b:e], np.float16)
                sim = (y @ y.T).astype(np.float64)
                i, j = np.nonzero(np.triu((sim > low[b:e, None]) | (sim > low[None, b:e]), 1))
                for o, z in zip(out, (ids[b + i], ids[b + j], sim[i, j]), strict=True):
                    o.append(z)
        if out[0]:
            a, b, sim = map(np.concatenate, out)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((hi, lo))
            lo, hi, sim = lo[order], hi[order], sim[order]
            keep = (lo != hi) & np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(lo[keep]), pa.array(hi[keep]), pa.array(sim[keep])], ["a", "b", "sim"])

    back = Window.partitionBy("mid").orderBy(F.desc("sim"), "id")
    lows = lists.groupBy("a").agg(F.min(F.when(F.col("full"), F.col("last")).otherwise(p.threshold - p.near)).alias("low"))
    there = lists.select(F.col("a").alias("mid"), F.col("b").alias("id"), "sim", "k")
    # those that list the node, as many as a list holds: a node that very many list joins its nearest ones
    here = lists.select(F.col("b").alias("mid"), F.col("a").alias("id"), "sim", "k").withColumn("r", F.row_number().over(back)).where("r <= k").drop("r")
    near = there.unionByName(here).select("mid", "id").distinct()
    full = nodes.select("id", "h").join(lows.withColumnRenamed("a", "id"), "id")
    return near.join(full, "id").select("mid", "id", "low", "h").repartition("mid").sortWithinPartitions("mid").mapInArrow(run, EDGE)


def confirmed(edges: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The links (a < b) among edges: those within reach of the threshold, compared again in doubles."""

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64) >= p.threshold:
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    near = edges.where(F.col("sim") >= p.threshold - LOOSE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = nodes.select(F.col("id").alias("a"), "x"), nodes.select(F.col("id").alias("b"), F.col("x").alias("y"))
    return near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def crowded(linked: DataFrame, p: Params) -> DataFrame:
    """(id): nodes with p.k links (a, b) or more, all those whose lists may be saturated among them."""
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("id")).count().where(F.col("count") >= p.k).select("id")


def exact(nodes: DataFrame, chosen: DataFrame | None, p: Params) -> DataFrame:
    """Edges (a, b) with the components of all links of the nodes chosen (id; None: of all nodes), found by comparing them with all.

    Blocks of chosen nodes meet blocks of all nodes of their label and length; of a pair of blocks only a forest of its links goes out.
    """
    rows = nodes.select("id", "label", "dim", "x")
    own = rows if chosen is None else rows.join(chosen, "id", "left_semi")
    count = lambda df, name: df.groupBy("label", "dim").agg(F.ceil(F.sum(F.col("dim") * 8) / p.block).cast("int").alias(name))
    parts = count(rows, "every").join(count(own, "some"), ["label", "dim"])
    at = lambda name: F.pmod(F.xxhash64("id", F.lit(5)), F.col(name)).cast("int")
    left = own.join(parts, ["label", "dim"]).withColumn("i", at("some")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("every") - 1)))
    right = rows.join(parts, ["label", "dim"]).withColumn("j", at("every")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("some") - 1)))
    if chosen is None:  # a pair of blocks once
        left, right = left.where("i <= j"), right.where("i <= j")
    one, two = (df.select("label", "dim", "i", "j", "id", "x").toDF(*(f"{c}{side}" for c in ("label", "dim", "i", "j")), "id", "x") for side, df in enumerate((left, right)))
    cells = one.groupBy("label0", "dim0", "i0", "j0").cogroup(two.groupBy("label1", "dim1", "i1", "j1"))

    def links(one, two):
        a, b = one.column("id").to_numpy(), two.column("id").to_numpy()
        x, y = stack(one.column("x")), stack(two.column("x"))
        for k in range(0, len(a), 512):
            i, j = np.nonzero(x[k : k + 512] @ y.T >= p.threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[k + i]), pa.array(b[j])], ["a", "b"])

    def run(one, two):
        found = list(contract(links(one, two))) if one.num_rows and two.num_rows else []
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return cells.applyInArrow(run, "a long, b long")


def audit(nodes: DataFrame, labels: DataFrame, settled: DataFrame, n: int, p: Params) -> tuple[float, DataFrame]:
    """Recall of the components on a sample, and the sample's links (a, b): the sample is compared with all nodes.

    Links of nodes that are settled (id; their links are all known) do not count, as they would hide what is missed elsewhere.
    """
    rows = nodes.where(share("id", p.audit / max(1, n))).select("id", "label", "dim", "x").collect()
    by: dict[tuple[int, int], list] = {}
    for r in rows:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    sample = {k: (np.array([r["id"] for r in v]), np.frombuffer(b"".join(bytes(r["x"]) for r in v), np.float64).reshape(len(v), -1)) for k, v in by.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            label, dim = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for key, (ids, q) in shared.value.items():
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if at.size:
                    own = batch.column(0).to_numpy()[at]
                    i, j = np.nonzero(q @ stack(batch.column(3).take(pa.array(at))).T >= p.threshold)
                    keep = ids[i] != own[j]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(own[j[keep]])], ["a", "b"])

    found = materialize(nodes.select("id", "label", "dim", "x").mapInArrow(run, "a long, b long"), "audit")
    one, two = labels.toDF("a", "la"), labels.toDF("b", "lb")
    judged = found.join(settled.toDF("a"), "a", "left_anti").join(settled.toDF("b"), "b", "left_anti")
    total, met = judged.join(one, "a", "left").join(two, "b", "left").agg(F.count("*"), F.count_if(F.col("la") == F.col("lb"))).first()
    return (met / total if total else 1.0), found


def degrees(nodes: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(id, links): how many rows of other nodes each node of a component is linked with; all pairs of a component, in blocks.

    A block holds p.block bytes of vectors, and a component of b blocks sends each vector b times. Small components share tasks.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("m"))
    member = nodes.select("id", "n", "dim", "x").join(labels.withColumnRenamed("label", "comp"), "id").join(sizes.withColumnRenamed("label", "comp"), "comp")
    parts = F.ceil(F.col("m") * F.col("dim") * 8 / p.block).cast("int")
    dealt = member.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bundle = F.pmod(F.xxhash64("comp", F.lit(9)), F.lit(4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cell = dealt.select("comp", "id", "n", "x", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("m") <= 64).alias("tiny"))
    cell = cell.withColumn("key", F.when(F.col("tiny"), bundle).otherwise(F.xxhash64("comp", "i", "j")))

    def run(key, tbl):
        tbl = tbl.sort_by([("comp", "ascending"), ("i", "ascending"), ("j", "ascending")])
        comp, ids, n, own, i, j = (tbl.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "id", "n", "own", "i", "j"))
        x = tbl.column("x").to_pylist()
        out = np.zeros(len(ids), np.int64)
        change = (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cut = np.append(np.append(0, np.flatnonzero(change) + 1), len(ids))
        for b, e in zip(cut[:-1], cut[1:], strict=True):
            y = stack(x[b:e])
            one = np.arange(e - b) if i[b] == j[b] else np.flatnonzero(own[b:e] == i[b])
            two = one if i[b] == j[b] else np.flatnonzero(own[b:e] == j[b])
            for k in range(0, one.size, 512):
                at = one[k : k + 512]
                hit = y[at] @ y[two].T >= p.threshold
                if i[b] == j[b]:
                    hit[np.arange(at.size), np.arange(k, k + at.size)] = False
                out[b + at] += hit @ n[b + two]
                if i[b] != j[b]:
                    out[b + two] += hit.T @ n[b + at]
        return pa.table({"id": pa.array(ids), "links": pa.array(out)})

    return cell.groupBy("key").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall of every row of vectors (vec_id, embedding, label).

    Rows are compared when their labels (of any plain type) are equal and not null and their vectors have the same length; rows whose vector
    is null, empty, zero, or holds a null or non-finite component are linked with nothing: n_links 0 and their own vec_id as component. Equal
    vectors are linked, repeated rows too. A null vec_id names no component unless all of it is null. Vectors may be of any length; other
    columns are not looked at. An empty table gives an empty table.

    recall is the share of the audit's links that were found, the same in every row: 1 where all nodes of a label were compared, as happens
    where it would lie below p.recall.
    """
    label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("id", F.when(sound, F.xxhash64("label", "embedding")))
    with scratch() as keep:
        nodes = materialize(nodes_of(rows.where("id is not null")), "nodes")
        n = nodes.count()
        edges = materialize(windows(nodes, n, 0, p), "windows")
        near = lambda df: df.where(F.col("sim") >= p.threshold - LOOSE)
        lengths = None
        for attempt in range(p.tries):
            for _ in range(p.rounds):
                lists = materialize(best(edges, lengths, p), "lists")
                lengths = lists.where((F.col("last") >= p.threshold - LOOSE) & F.col("full")).groupBy("a").agg(F.least(F.max("k") * 2, F.lit(p.k_most)).alias("k"))
                fresh = materialize(refine(lists, nodes, p), "refined")
                before, added = near(lists).count() / 2, near(fresh).join(lists.select("a", "b"), ["a", "b"], "left_anti").count()
                edges = lists.select("a", "b", "sim").unionByName(fresh).where(F.col("sim") >= p.threshold - p.near)
                if added <= p.settled * before:
                    break
            linked = materialize(confirmed(edges, nodes, p), "linked")
            dense = materialize(crowded(linked, p), "crowded")
            if not dense.isEmpty():
                linked = linked.unionByName(materialize(exact(nodes, dense, p), "exact"))
            labels = components(linked)
            recall, sampled = audit(nodes, labels, dense, n, p)
            if recall >= p.recall:
                break
            edges = edges.unionByName(materialize(windows(nodes, n, (attempt + 1) * p.orders, p), "windows"))
        if recall < p.recall:
            labels, recall = components(exact(nodes, None, p)), 1.0
        elif recall < 1:  # what the audit saw counts
            labels = components(linked.unionByName(sampled))
        links = degrees(nodes, labels, p)
        known = nodes.select("id", "n").join(labels, "id", "left").join(links, "id", "left").select("id", F.coalesce("label", "id").alias("label"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        known = materialize(known, "known")
        first = rows.where("id is not null").groupBy("id").agg(F.min("vec_id").alias("first")).join(known, "id").groupBy("label").agg(F.min("first").alias("component"))
        named = known.join(first, "label").select("id", "n_links", "component")
        out = rows.select("vec_id", "id").join(named, "id", "left")
        component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"))
        return keep(materialize(out, "near-duplicates"))


def op2_embedding_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and the rows kept of all embeddings at cosine 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what they reach (links join what has the same vectors, too).
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), low AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = low.vec_id) AS n_links, component_id, vec_id = component_id AS kept, CAST(1 AS DOUBLE) AS recall FROM low
"""
