"""Joins, search, dedup and mixing against brute force, with ties, repeats, nulls and groups large enough for every path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbed.llm import embedding_dedup, jaccard, mixing, topk
from riverbed.llm.graph import components


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got[40] == 0 and got[101] == 100 and len(got) == 43


def plain_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(root, i)] = find(root, j)
                links[i] += 1
                links[j] += 1
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(root, k)] = min(low.get(find(root, k), 1 << 60), d)
    return sorted((d, len(sets[k]), low[find(root, k)] if sets[k] else d, links[k]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("p", [jaccard.Params(), jaccard.Params(family=3, leaders=1, together=4, part=6, open_part=5, often=2, shared=3), jaccard.Params(hold=600, told=1)])
def test_jaccard_join(spark, p):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(6):  # families of near copies around a base, some of them borderline
        text = [word() for _ in range(rng.choice((12, 40, 90)))]
        for _ in range(rng.choice((3, 12, 30))):
            copy = list(text)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(30)] + passage) for _ in range(25)] + ["A b  C", "a B\tc", "", None, "  ", "one", "x y z w v", rows[0], rows[0].upper()]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("sig", F.lit(2)).repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_links(df, p).drop("component_key", "text_hash").collect())) == plain_links(rows)


def test_overlaps_from_differences():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [base, base[:40]] + [np.unique(np.concatenate((rng.choice(base, int(rng.integers(1, 300)), replace=False), rng.integers(0, 2**64, 20, dtype=np.uint64)))) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(20)]
    got = jaccard.shared_counts(sets, block=64)
    assert all(got[i, j] == np.intersect1d(a, b).size for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
    hit = jaccard.linked(sets, None, 80)
    assert (hit == hit.T).all() and not hit.diagonal().any()


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted((r["component_id"] is None, r["component_id"], r["n_links"]) for r in jaccard.jaccard_links(df).collect()) == [(False, 5, 2)] * 3 + [(True, None, 0)]
    assert jaccard.jaccard_links(df.limit(0)).count() == 0


def test_sketch_bounds_never_undercut():
    rng = np.random.default_rng(1)
    for n in (1, 40, 900, 5000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: n // 2], rng.integers(0, 2**64, n // 2 + 1, dtype=np.uint64))))
        assert jaccard.most_shared(jaccard.sketch(x), x.size, jaccard.sketch(y), y.size) >= np.intersect1d(x, y).size
        assert (jaccard.unpack_set(jaccard.pack(x)) == x >> np.uint64(16)).all()


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=6)]) for k in range(230)] + [(500, [0.5] * 6), (501, [0.5] * 6), (502, None), (503, [float("nan")] * 6), (504, [None] * 6), (None, [9.0] * 6), (550, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    sound = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in sound:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in sound if j != i and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for p in (topk.Params(), topk.Params(shard=40, part=2, leaf=4), topk.Params(shard=7, part=3, leaf=2, pivots=5)):
        assert sorted(map(tuple, topk.top_k(df, lambda c: c % 50 == 0, p).collect())) == sorted(want)
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1e3, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(big, lambda c: c == 0).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, [float(v) for v in rng.normal(size=16)], label) for k in range(60)]
        rows += [(len(rows) + k, [float(v) for v in centre + 0.25 * rng.normal(size=16)], label) for k in range(70)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [0.0] * 16, 0), (906, [float("inf")] * 16, 0), (907, [1.0, None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(1)).withColumn("id", F.lit(2))
    sound = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if g is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for a, (i, v, g) in enumerate(sound):
        for j, w, h in sound[:a]:
            if g == h and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(root, i), find(root, j)
                root[max(x, y)] = min(x, y)
    want = sorted((i, links[i], find(root, i), find(root, i) == i) for i, *_ in rows)
    for p in (embedding_dedup.Params(), embedding_dedup.Params(block=2048, k=4, k_most=8)):
        assert sorted(tuple(r)[:4] for r in embedding_dedup.near_duplicates(df, p).collect()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_saturated_lists(spark):
    rng = np.random.default_rng(8)
    spread = lambda centre: [centre / np.linalg.norm(centre) + 0.02 * rng.normal(size=16) for _ in range(60)]
    one = np.eye(16)[0]
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(spread(one) + spread(0.94 * one + np.sqrt(1 - 0.94**2) * np.eye(16)[1]))]
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = (v @ v.T >= 0.93).sum(1) - 1
    assert (v[:60] @ v[60:].T >= 0.93).sum() > 100 and (v[:60] @ v[:60].T).min() > 0.97
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = [(k, int(n), 0, k == 0) for k, n in enumerate(links)]
    found = lambda **p: sorted(tuple(r)[:4] for r in embedding_dedup.near_duplicates(df, embedding_dedup.Params(**p)).collect())
    assert found(audit=0) == want  # no audit, which would compare all of so few nodes
    assert found(audit=0, block=4096) == want
    # a bound out of reach and no node crowded: all nodes are compared
    assert found(audit=0, orders=1, window=1, rounds=1, tries=1, k=200, block=6400, recall=1.1) == want


def test_embedding_dedup_near_the_threshold(spark):
    rng, rows = np.random.default_rng(9), []
    for k in range(150):  # pairs at 0.925 to 0.935, of labels that are texts
        a, b = rng.normal(size=(2, 24))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = 0.925 + 0.01 * k / 150
        rows += [(2 * k, [float(x) for x in a], f"l{k % 3}"), (2 * k + 1, [float(x) for x in c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)], f"l{k % 3}")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = [(k, int(0.925 + 0.01 * (k // 2) / 150 >= 0.93)) for k in range(300)]
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == want and {r["recall"] for r in got} == {1.0}


def test_mixing(spark):
    letters = {"x": "eee tt ", "y": "zzz qq ww ", "z": "üü ßß öö "}
    rows = [(k, letters[d] * (3 + k % 5), d if k % 6 else None) for k, d in enumerate("xxxxxxyyyz" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit(5)).withColumn("tokens", F.lit("t")).withColumn("row", F.lit(1)).withColumn("p", F.lit("q"))
    got = mixing.mix(docs, "lang").cache()
    sums = {r["domain"]: r["s"] for r in got.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("rate")).alias("s")).collect()}
    assert max(sums.values()) / min(sums.values()) < 1.02 and got.agg(F.min("rate")).first()[0] >= 0.99
    assert sum(r["domain"] == dict(enumerate("xxxxxxyyyz" * 40))[r["doc_id"]] for r in got.collect()) >= 396
    wanted = mixing.mix(docs, "lang", p=mixing.Params(targets={"x": 0.5, "y": 0.5}))
    assert wanted.where("domain = 'z' and rate > 0.05").count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, "eee", None)], "doc_id long, text string, lang string")
    assert mixing.mix(odd, "lang").count() == 4 and mixing.mix(odd.where("lang is null"), "lang").where("rate <> 1").count() == 0 and mixing.mix(odd.limit(0), "lang").count() == 0
