"""Exact n-gram Jaccard self-join with set-relation skipping.

Any two sets of the wanted similarity share a certain number of the first few shingles of each (a prefix) in any fixed order of all
shingles. The order puts shingles that occur often last, so prefixes are rare ones. Prefix entries go to an inverted index; its lists are
sorted by set size and position, and blocks that cannot reach the wanted overlap are skipped without looking at their entries. Long lists belong to families
of similar sets: there, a few leading sets are compared with all others first; the answers found for a leader stand for the sets it is
linked with, and only pairs that these answers leave open are compared afterwards. Equal sets are joined once, through a signature.

Sets that candidate pairs connect are a family, and all its pairs are answered exactly: one set is compared with every other, and what each
has less and more than that one gives the overlap of any two of them without looking at what they have in common.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches, table
from .graph import components
from .shingles import U64, mix, of_worker, signature

NO_ID = -(2**63)
LEAST_BITS = 10


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: Similarity in hundredths.
    percent: int = 80
    #: Prefix shingles that a pair must share; prefixes are so much longer that no similar pair shares fewer.
    shared: int = 16
    #: A shingle found in so many sets counts as frequent; the order needs the most frequent ones only, and is exact with any of them.
    often: int = 4
    table_of_frequent: int = 200_000
    #: Lists above this length are taken for families.
    family: int = 24
    leaders: int = 8
    #: Long lists that each set knows of when pairs are told of once.
    first_lists: int = 8
    #: Entries of a list that one task takes; longer lists are dealt in pairs of parts. open_part: where all their pairs are looked at.
    part: int = 20_000
    open_part: int = 4_096
    #: Of every so many sets, one (by its signature) tells all its shingles, so that frequent ones are counted over the whole corpus.
    told: int = 64
    #: Index entries a bucket holds on average.
    bucket: int = 50_000
    #: Sets of a family that meet in one task, and the shingles that they hold; larger families are dealt in pairs of parts.
    together: int = 1_000
    hold: int = 1_000_000


def least_overlap(a, b, percent: int):
    """Shared shingles that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, p: Params):
    return min(n, n + p.percent * -n // 100 + p.shared)


def needed(na, nb, p: Params):
    """Prefix shingles that sets of sizes na and nb share if they are similar."""
    return np.minimum(p.shared, least_overlap(na, nb, p.percent))


def read_sets(batches, k: int, most: int = 500_000):
    """Blocks of (the columns beside text by row, shingle arrays, signatures), a bounded number of shingles at a time."""
    shingler, ids, sets, sigs, held = of_worker(k), [], [], [], 0
    for batch in batches:
        beside = zip(*(c.to_pylist() for k, c in enumerate(batch.columns) if k != 1), strict=True)
        for d, t in zip(beside, batch.column(1), strict=True):
            s = shingler.shingles(t.as_py())
            ids.append(d)
            sets.append(s)
            sigs.append(signature(s))
            held += s.size
            if held >= most:
                yield ids, sets, sigs
                ids, sets, sigs, held = [], [], [], 0
    if ids:
        yield ids, sets, sigs


def sketch(s: np.ndarray) -> bytes:
    """A bit for each value of the upper bits of the shingles; 1024 bits, or half as many again as the set has shingles, or up to twice that."""
    k = max(LEAST_BITS, int(np.ceil(np.log2(1.5 * s.size)))) if s.size else LEAST_BITS
    bits = np.zeros(1 << k, np.uint8)
    bits[(s >> U64(64 - k)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_shared(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """No more shingles than this can be shared by two sets: a bit that one sketch alone has stands for a shingle of that set alone."""
    a, b = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
    while a.size > b.size:
        a = a.reshape(-1, 2).any(1)
    while b.size > a.size:
        b = b.reshape(-1, 2).any(1)
    a, b = a.astype(bool), b.astype(bool)
    both = int((a & b).sum())
    return min(nx - int(a.sum()) + both, ny - int(b.sum()) + both)


def describe(docs: DataFrame, p: Params) -> DataFrame:
    """kind 0: doc_id, text_hash, n, sig and sketch of every row. kind 1: sig holds a shingle found in n >= 2 different sets of one block of texts;
    kind 2: one found in n of the sets that tell all theirs."""

    def counted(kind, sets, least):
        h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U64), np.zeros(0, np.int64))
        h, n = h[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array(np.full(h.size, kind, np.int32)), pa.nulls(h.size, pa.int64()), pa.nulls(h.size, pa.int64()), pa.array(n.astype(np.int64)), pa.array(h.view(np.int64)), pa.nulls(h.size, pa.binary())], names)

    def run(batches):
        for ids, sets, sigs in read_sets(batches, p.words):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), *(pa.array(x, pa.int64()) for x in zip(*ids, strict=True)), pa.array([s.size for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(map(sketch, sets), pa.binary())], names)
            sig, at = np.unique(np.array(sigs), return_index=True)
            yield counted(1, [sets[k] for k in at], 2)
            yield counted(2, [sets[k] for k in at[mix(sig.view(U64)) % U64(p.told) == 0]], 1)

    names = ["kind", "doc_id", "text_hash", "n", "sig", "sketch"]
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "kind int, doc_id long, text_hash long, n long, sig long, sketch binary")


def frequent_shingles(described: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and about how many sets hold each: the larger of what blocks counted and what a share of all sets tells."""
    sums = described.where("kind > 0").groupBy("sig").agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("near"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("told"))
    n = F.greatest(F.col("near"), F.when(F.col("told") > 2, F.col("told") * p.told))
    rows = sums.select("sig", n.alias("n")).where(F.col("n") >= p.often).orderBy(F.desc("n"), "sig").limit(p.table_of_frequent).collect()
    known = np.array([r[0] for r in rows], np.int64).view(U64)
    order = np.argsort(known)
    return known[order], np.array([r[1] for r in rows], np.int64)[order]


def index_entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, p: Params) -> DataFrame:
    """(bucket, entries): for each block of texts and bucket, the prefix entries packed as arrays of shingle, sig, n and position."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known, count = shared.value
        for _, sets, sigs in read_sets(batches, p.words):
            hs, ss, ns, ps = [], [], [], []
            for k in np.unique(np.array(sigs), return_index=True)[1]:
                h = sets[k]
                if not h.size:
                    continue
                at = np.minimum(np.searchsorted(known, h), max(0, known.size - 1))
                weight = np.where(known[at] == h, count[at], 0) if known.size else np.zeros(h.size, np.int64)
                take = np.lexsort((h, weight))[: prefix_length(h.size, p)]
                hs.append(h[take])
                ss.append(np.full(take.size, sigs[k]))
                ns.append(np.full(take.size, h.size))
                ps.append(np.arange(take.size))
            if not hs:
                continue
            h, s, n, pos = map(np.concatenate, (hs, ss, ns, ps))
            to = (mix(h) % U64(buckets)).astype(np.int64)
            # lists too long for one task: each entry meets every part of its list, one pair of parts at a time
            at = np.minimum(np.searchsorted(known, h), max(0, known.size - 1))
            parts = np.where(known[at] == h, -(-count[at] // p.part), 1) if known.size else np.ones(h.size, np.int64)
            if (parts > 1).any():
                long, short = np.flatnonzero(parts > 1), np.flatnonzero(parts <= 1)
                row = np.repeat(long, parts[long])
                own = (mix(s.view(U64)) % parts.astype(U64)).astype(np.int64)[row]
                other = np.concatenate([np.arange(m) for m in parts[long]])
                cell = (mix(h[row] + mix((np.minimum(own, other) * 1_000_003 + np.maximum(own, other)).astype(U64))) >> U64(2)).astype(np.int64) + buckets
                h, s, n, pos, to = (np.concatenate((x[short], x[row])) for x in (h, s, n, pos, to))
                to[short.size :] = cell
            order = np.argsort(to, kind="stable")
            h, s, n, pos, to = h[order], s[order], n[order].astype(np.uint32), np.minimum(pos[order], 65535).astype(np.uint16), to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            begin, end = np.append(0, cut), np.append(cut, to.size)
            yield pa.RecordBatch.from_arrays([pa.array(to[begin]), pa.array([h[i:j].tobytes() + s[i:j].tobytes() + n[i:j].tobytes() + pos[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())], ["bucket", "entries"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, entries binary")


def unpack(blobs) -> tuple[np.ndarray, ...]:
    out = [[], [], [], []]
    for b in blobs:
        m = len(b) // 22
        for x, kind, at in zip(out, (U64, np.int64, np.uint32, np.uint16), (0, 8 * m, 16 * m, 20 * m), strict=True):
            x.append(np.frombuffer(b, kind, m, at))
    h, s, n, pos = (np.concatenate(x) for x in out)
    return h, s, n.astype(np.int64), pos.astype(np.int64)


def fits(na, pa_, nb, pb, percent: int):
    """Whether two entries of one list can belong to sets that are similar: by size, and by what is left after their positions."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * low >= percent * high) & (1 + np.minimum(pa_, pb) + np.minimum(na - pa_ - 1, nb - pb - 1) >= least_overlap(na, nb, percent))


def list_pairs(n, pos, i, j, percent: int, block: int = 512):
    """Pairs (x, y) of positions, x from i, y from j, that fit. n and pos are sorted by n; blocks of j that are too large or small are skipped."""
    for b in range(0, len(j), block):
        part = j[b : b + block]
        rows = i[(100 * n[i] >= percent * n[part[0]]) & (percent * n[i] <= 100 * n[part[-1]])]
        if rows.size:
            x, y = np.nonzero(fits(n[rows][:, None], pos[rows][:, None], n[part][None], pos[part][None], percent))
            yield rows[x], part[y]


FOUND = "kind int, bucket long, a long, b long, n long, pos long"


def pairs_table(kind: int, bucket: int, a, b, need) -> pa.Table:
    """Distinct pairs (low, high) of sigs with how often each came up (n) and how often it has to (pos)."""
    keep = a != b
    low, high, need = np.minimum(a, b)[keep], np.maximum(a, b)[keep], need[keep]
    order = np.lexsort((high, low))
    low, high, need = low[order], high[order], need[order]
    at = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if low.size else np.zeros(0, np.int64)
    m = at.size
    return pa.table({"kind": pa.array(np.full(m, kind, np.int32)), "bucket": pa.array(np.full(m, bucket, np.int64)), "a": pa.array(low[at]), "b": pa.array(high[at]), "n": pa.array(np.diff(np.append(at, low.size))), "pos": pa.array(need[at])})


def candidates(entries: DataFrame, p: Params) -> DataFrame:
    """kind 0: pairs of short lists; kind 2: pairs with a leader of a long list (see pairs_table); kind 1: the entries of long lists, a
    the list's shingle, b the sig."""

    def run(key, tbl):
        bucket = key[0].as_py()
        h, s, n, pos = unpack(tbl.column("entries").to_pylist())
        order = np.lexsort((s, pos, n, h))
        h, s, n, pos = h[order], s[order], n[order], pos[order]
        new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        h, s, n, pos = h[new], s[new], n[new], pos[new]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        length = np.diff(np.append(begin, h.size))
        none = np.zeros(0, np.int64)
        short, led, long = [(none, none)], [(none, none)], [none]
        for size in range(2, p.family + 1):  # all lists of one length at a time
            rows = begin[length == size]
            if rows.size:
                x, y = np.triu_indices(size, 1)
                x, y = (rows[:, None] + x).ravel(), (rows[:, None] + y).ravel()
                keep = fits(n[x], pos[x], n[y], pos[y], p.percent)
                short.append((x[keep], y[keep]))
        for b, size in zip(begin[length > p.family], length[length > p.family], strict=True):
            at = np.arange(b, b + size)
            long.append(at)
            led += list_pairs(n, pos, at[leaders_of(s[at], n[at], p)], at, p.percent)
        out = []
        for kind, found in ((0, short), (2, led)):
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            out.append(pairs_table(kind, bucket, s[x], s[y], needed(n[x], n[y], p)))
        at = np.concatenate(long)
        out.append(pa.table({"kind": pa.array(np.ones(at.size, np.int32)), "bucket": pa.array(np.full(at.size, bucket, np.int64)), "a": pa.array(h[at].view(np.int64)), "b": pa.array(s[at]), "n": pa.array(n[at]), "pos": pa.array(pos[at])}))
        return pa.concat_tables(out)

    return entries.groupBy("bucket").applyInArrow(run, FOUND)


def leaders_of(s: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Some entries of each band of sizes, the same sets in every list that they share."""
    out, b = [], 0
    while b < n.size:
        e = int(np.searchsorted(n * p.percent, n[b] * 100, "right"))
        out.append(b + np.argsort(mix(s[b:e].view(U64)), kind="stable")[: p.leaders])
        b = e
    return np.concatenate(out)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at 1024 bits each, as rows of 0 and 1."""
    out = np.zeros((len(sketches), 1 << LEAST_BITS), np.float32)
    for k, z in enumerate(sketches):
        out[k] = np.unpackbits(np.frombuffer(z, np.uint8)).reshape(1 << LEAST_BITS, -1).max(1)
    return out


def open_pairs(long: DataFrame, labels: DataFrame, classes: DataFrame, p: Params, block: int = 512) -> DataFrame:
    """Pairs of long lists whose sets no leader's answers have joined so far (kind 3, see pairs_table) and whose sketches leave room.

    A list is dealt in pairs of parts, and taken in pairs of blocks, sorted by size; blocks too far apart in size are skipped, and the
    sketches of two blocks are compared in one product. A pair is told of once and not by every list it shares: each set knows the few of its long lists that come
    first by a hash, and where two sets know of a common one, only the first such list tells.
    """

    def run(key, tbl):
        s, n, pos, label = (tbl.column(c).to_numpy() for c in ("b", "n", "pos", "label"))
        order = np.lexsort((pos, n))
        s, n, pos, label = s[order], n[order], pos[order], label[order]
        none = np.zeros(0, np.int64)
        found = [(none, none)]
        if (label != label[0]).any():
            blobs, lid, own, cross = tbl.column("sketch"), tbl.column("lid")[0].as_py(), tbl.column("own").to_numpy()[order], tbl.column("i")[0] != tbl.column("j")[0]
            firsts = np.full((s.size, p.first_lists), np.iinfo(np.int64).max)
            for k, z in enumerate(tbl.column("firsts").take(pa.array(order)).to_pylist()):
                firsts[k, : len(z)] = z
            bits = lambda i: folded(blobs.take(pa.array(order[i : i + block])).to_pylist())
            for i in range(0, s.size, block):
                one = bits(i)
                for j in range(i, s.size, block):
                    if p.percent * n[j] > 100 * n[min(i + block, s.size) - 1]:
                        break
                    two = bits(j) if j > i else one
                    x, y = np.arange(i, i + len(one))[:, None], np.arange(j, j + len(two))[None]
                    both = one @ two.T
                    most = np.minimum(n[x] - one.sum(1)[:, None], n[y] - two.sum(1)[None]) + both
                    keep = (x < y) & (label[x] != label[y]) & (most >= least_overlap(n[x], n[y], p.percent)) & fits(n[x], pos[x], n[y], pos[y], p.percent)
                    keep = keep & (own[x] != own[y]) if cross else keep
                    for u, v in zip(*(np.array_split(z, 1 + z.size // 20_000) for z in np.nonzero(keep)), strict=True):
                        f, g = firsts[u + i], firsts[v + j]
                        teller = np.where(f[:, :, None] == g[:, None, :], f[:, :, None], np.iinfo(np.int64).max).min((1, 2))
                        mine = (teller == lid) | (teller == np.iinfo(np.int64).max)
                        found.append((u[mine] + i, v[mine] + j))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        return pairs_table(3, 0, s[x], s[y], needed(n[x], n[y], p))

    marked = materialize(long.join(labels, long.b == labels.id, "left").select("bucket", "a", "b", "n", "pos", F.coalesce("label", "b").alias("label")), "marked")
    # lists that one label covers are done with
    lists = marked.groupBy("bucket", "a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    lists = materialize(lists.select(F.col("bucket").alias("k1"), F.col("a").alias("k2"), F.xxhash64("bucket", "a").alias("lid"), F.ceil(F.col("m") / p.open_part).cast("int").alias("parts")), "lists")
    marked = marked.join(lists, (marked.bucket == lists.k1) & (marked.a == lists.k2)).drop("k1", "k2")
    firsts = marked.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("lid")), 1, p.first_lists).alias("firsts"))
    marked = marked.join(firsts, "b").join(classes.select(F.col("sig").alias("b"), "sketch"), "b")
    marked = marked.withColumn("own", F.pmod(F.xxhash64("b", F.lit(3)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    marked = marked.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "parts")
    return marked.groupBy("bucket", "a", "i", "j").applyInArrow(run, FOUND)


def shared_enough(found: DataFrame) -> DataFrame:
    """Pairs that came up often enough over all lists; pairs with a leader need no count, as not every list has the same leaders."""
    sums = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("pos").alias("need"), F.max("kind").alias("kind"))
    return sums.where("n >= need or kind = 2")


def possible(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Those pairs whose sketches leave room for the overlap that they need."""

    def run(batches):
        for batch in batches:
            n, x, nx, y, ny = (batch.column(k).to_pylist() for k in range(2, 7))
            keep = [k for k in range(len(n)) if most_shared(x[k], nx[k], y[k], ny[k]) >= least_overlap(nx[k], ny[k], p.percent)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in range(3)], ["a", "b", "n"])

    one = classes.select(F.col("sig").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    two = classes.select(F.col("sig").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long, n long")


def wanted_bits(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of column key, 16 bits an id and 8 MB at most: beyond that more ids pass, and the join after it drops them.

    Segments of 64 KB are made by tasks, so that the driver is sent 128 of them at most.
    """
    bits = 1 << int(min(26, max(19, np.ceil(np.log2(16 * max(1, n))))))

    def run(key, tbl):
        out = np.zeros(1 << 19, np.uint8)
        out[tbl.column("spot").to_numpy() & ((1 << 19) - 1)] = 1
        return pa.table({"segment": [key[0].as_py()], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), F.lit(bits)) for k in range(3)])).alias("spot")).distinct()
    parts = spots.withColumn("segment", F.call_function("shiftright", "spot", F.lit(19))).groupBy("segment").applyInArrow(run, "segment long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for segment, blob in parts:
        out[segment << 16 : segment + 1 << 16] = np.frombuffer(blob, np.uint8)
    return out, bits


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, p: Params) -> DataFrame:
    """(sig, shingles) for wanted (sig, key): key is the id of some document with that set. Some other sets, and some twice, come too."""
    bloom, bits = wanted_bits(wanted, n)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        words, shingler = shared.value, of_worker(p.words)
        for batch in batches:
            spots = [batch.column(2 + k).to_numpy() for k in range(3)]
            hit = np.flatnonzero(np.logical_and.reduce([(words[x >> 3] >> (x & 7).astype(np.uint8)) & 1 for x in spots]))
            for b in range(0, hit.size, 256):
                sets = [shingler.shingles(t.as_py()) for t in batch.column(1).take(pa.array(hit[b : b + 256]))]
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], ["sig", "shingles"])

    key = F.coalesce("doc_id", F.lit(NO_ID))
    found = docs.select("doc_id", "text", *[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)).alias(f"s{k}") for k in range(3)]).mapInArrow(run, "sig long, shingles binary")
    return found


def pack(s: np.ndarray) -> bytes:
    """The upper six bytes of each shingle: two different ones of a pair of sets agree in them about once in 10**9 pairs."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def shared_counts(sets: list[np.ndarray], block: int = 2048) -> np.ndarray:
    """How many shingles any two of some sorted sets share (above the diagonal), from their differences to a leader of middle size.

    With less(x) and more(x), what x lacks of the leader L and has beyond it: |x & y| = |x & L| + |y & L| - |L| + |less(x) & less(y)| +
    |more(x) & more(y)|. A shingle that only one set lacks, or only one has beyond the leader, plays no part.
    """
    m, size = len(sets), np.array([s.size for s in sets])
    lead = sets[int(np.argsort(size, kind="stable")[m // 2])]
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    at = np.minimum(np.searchsorted(lead, flat), lead.size - 1)
    own = lead[at] == flat
    lacks = np.ones((m, lead.size), bool)
    lacks[row[own], at[own]] = False
    kept = lead.size - lacks.sum(1)
    less_row, less = np.nonzero(lacks)
    more = np.unique(flat[~own], return_inverse=True)[1]
    r, c = np.concatenate((less_row, row[~own])), np.concatenate((less, lead.size + more))
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    begin = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if c.size else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, c.size))
    both = (kept[:, None] + kept[None] - lead.size).astype(np.float32)
    few = max(8, min(64, m // 5))
    told, n = [], 0
    for k in range(2, few + 1):  # shingles in few differences: their pairs, one by one
        first = begin[length == k]
        x, y = np.triu_indices(k, 1)
        for part in np.array_split(first, 1 + first.size * x.size // 1_000_000) if first.size else ():
            rows = r[part[:, None] + np.arange(k)]
            told.append((rows[:, x] * m + rows[:, y]).ravel())
            n += told[-1].size
            if n > 2_000_000:
                both += np.bincount(np.concatenate(told), minlength=m * m).reshape(m, m)
                told, n = [], 0
    if told:
        both += np.bincount(np.concatenate(told), minlength=m * m).reshape(m, m)
    first, count = begin[length > few], length[length > few]
    for k in range(0, first.size, block):  # the others: products of blocks of them
        f, num = first[k : k + block], count[k : k + block]
        spot = np.repeat(f - np.append(0, np.cumsum(num)[:-1]), num) + np.arange(num.sum())
        dense = np.zeros((m, f.size), np.float32)
        dense[r[spot], np.repeat(np.arange(f.size), num)] = 1
        both += dense @ dense.T
    return both


def linked(sets: list[np.ndarray], allowed: np.ndarray | None, percent: int) -> np.ndarray:
    """Which two of some sets are similar, as a symmetric matrix; allowed: whether a pair is looked at at all (None: every one)."""
    size = np.array([s.size for s in sets])
    shared = np.rint(shared_counts(sets)).astype(np.int64)
    hit = np.triu(100 * shared >= percent * (size[:, None] + size[None] - shared), 1)
    if allowed is not None:
        hit &= allowed
    return hit | hit.T


def forest(hit: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    root = np.full(len(hit), -1)
    for k in range(len(hit)):
        if root[k] < 0:
            root[k], front = k, np.array([k])
            while front.size:
                new = hit[front].any(0) & (root < 0)
                root[new], front = k, np.flatnonzero(new)
    return root


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: Params, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact links among the sets that pairs (a, b of sigs) connect, and the families (id, label) that they form.

    The links are kind 0: a and b, enough of them to join all that are similar; kind 1: b rows of other sets are linked with a. known:
    families (id, label) whose links are known already; links inside one of them are left out.

    All pairs of a family are answered in one task, a bundle of small families or a pair of parts of a large one, so each set is sent once
    for each part, whatever the number of its pairs.
    """
    labels = components(pairs, "families")
    at = labels.join(classes.select("sig", "first", "rows", F.col("n").alias("size")), F.col("id") == F.col("sig")).select("sig", F.coalesce("first", F.lit(NO_ID)).alias("key"), F.col("label").alias("comp"), "rows", "size")
    again = known is not None
    at = at.join(known.select(F.col("id").alias("sig"), F.col("label").alias("old")), "sig", "left").withColumn("old", F.coalesce("old", "sig")) if again else at.withColumn("old", F.col("sig"))
    weight = at.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / p.together), F.ceil(F.sum("size") / p.hold)).cast("int").alias("parts"))
    members = materialize(at.join(weight, "comp"), "members")
    n, held = members.agg(F.count("*"), F.sum("size")).first()
    sets = sets_of(docs, members.select("key"), n, p)
    own = F.pmod(F.xxhash64("sig", F.lit(3)), "parts").cast("int")
    place = members.select(F.col("sig").alias("of"), "comp", "rows", "old", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(1 + max((held or 0) // p.hold, n // p.together)))).otherwise(F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")))
    place = place.select("of", "comp", "rows", "old", "own", (F.col("own") != F.col("other")).alias("cross"), cell.alias("cell"))
    dealt = sets.join(place, sets.sig == place.of).select("cell", "comp", "sig", "rows", "old", "own", "cross", "shingles")

    def run(tbl: pa.Table) -> pa.Table:
        comp, sig, rows, old, own, cross = (tbl.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "sig", "rows", "old", "own", "cross"))
        blobs = tbl.column("shingles")
        order = np.lexsort((sig, comp))
        order = order[np.append(True, (comp[order][1:] != comp[order][:-1]) | (sig[order][1:] != sig[order][:-1]))]
        cut = np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1]))
        kinds, ones, twos = [], [], []
        for b, e in zip(cut, np.append(cut[1:], order.size), strict=True):
            k = order[b:e]
            if k.size < 2:
                continue
            allowed = None
            if cross.any() and own[k].min() != own[k].max():  # two parts of one family: their own pairs are other tasks' work
                allowed = own[k][:, None] != own[k][None]
            if again:
                apart = old[k][:, None] != old[k][None]
                allowed = apart if allowed is None else allowed & apart
            hit = linked([unpack_set(x) for x in blobs.take(pa.array(k)).to_pylist()], allowed, p.percent)
            root, links = forest(hit), hit @ rows[k]
            for kind, some, x, y in ((0, root != np.arange(k.size), sig[k][root], sig[k]), (1, links > 0, sig[k], links)):
                kinds.append(np.full(int(some.sum()), kind, np.int32))
                ones.append(x[some])
                twos.append(y[some])
        join = lambda z, kind: np.concatenate(z) if z else np.zeros(0, kind)
        return pa.table({"kind": pa.array(join(kinds, np.int32), pa.int32()), "a": pa.array(join(ones, np.int64), pa.int64()), "b": pa.array(join(twos, np.int64), pa.int64())})

    return materialize(dealt.groupBy("cell").applyInArrow(run, "kind int, a long, b long"), "links"), labels


def jaccard_links(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and n_links (other rows linked
    directly) of every row of docs; component_key, equal for rows of one component with any word, and text_hash (xxhash64 of the text),
    which tell rows that share a doc_id apart.

    Two rows are linked when their sets' Jaccard similarity reaches p.percent / 100. Null, empty and blank texts have no shingles and are
    linked with nothing. Repeated rows stay, each with the component of its text, and are linked with one another. A null doc_id takes
    part, but never names a component unless every id of the component is null (then component_id is null). An empty table gives an empty
    table; texts may be of any length; other columns are not looked at. Similarity is exact but for collisions of 64-bit hashes, and of
    48-bit ones inside a family.
    """
    spark = docs.sparkSession
    with scratch() as keep, small_batches(spark):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        described = materialize(describe(docs, p), "shingles")
        rows = described.where("kind = 0")
        frequent = frequent_shingles(described, p)
        total = rows.agg(F.sum(F.col("n") * (100 - p.percent) / 100 + 1)).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = materialize(candidates(index_entries(docs, frequent, max(parts, int(total) // p.bucket), p), p), "candidates")
        long = found.where("kind = 1").drop("kind")
        classes = materialize(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows")), "classes")
        pairs = materialize(possible(shared_enough(found.where("kind <> 1")), classes, p), "pairs")
        links, families = verify(pairs, docs, classes, p)
        edges = links.where("kind = 0")
        labels = components(edges)
        if not long.isEmpty():
            left = materialize(open_pairs(long, labels, classes, p), "open").groupBy("a", "b").agg(F.sum("n").alias("n"))
            left = materialize(possible(left, classes, p), "pairs")
            if not left.isEmpty():
                more, _ = verify(left, docs, classes, p, families)
                links = links.unionByName(more)
                labels = components(links.where("kind = 0"))
        named = classes.select("sig", "first", "rows").join(labels, classes.sig == labels.id, "left").select("sig", F.coalesce("label", "sig").alias("label"), "first", "rows")
        lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
        others = links.where("kind = 1").groupBy(F.col("a").alias("sig")).agg(F.sum("b").alias("others"))
        by_sig = named.join(lowest, "label").join(others, "sig", "left").select("sig", "component_id", F.col("label").alias("component_key"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        out = rows.select("doc_id", "text_hash", "n", "sig").join(by_sig, "sig", "left")
        some = F.col("n") > 0
        return keep(materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(0).alias("n_links"), F.coalesce("component_key", "sig").alias("component_key"), "text_hash"), "near-copies"))


#: All pairs that share a shingle, counted, and what they reach.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e AS x JOIN e AS y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), low AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, low.component_id, (SELECT count(*) FROM links WHERE a = s.doc_id) AS n_links FROM s JOIN low USING (doc_id)
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components and links of all documents at five words and similarity 0.8."""
    return jaccard_links(table(spark, sf_dir, "documents")).drop("component_key", "text_hash")
