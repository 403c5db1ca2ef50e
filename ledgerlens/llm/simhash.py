"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within RADIUS bits of each other share a point within RADIUS / 2 bits of both. So every distinct
fingerprint emits all its variants within half the radius, variants are shuffled, and the fingerprints that meet on
one are verified and linked to the smallest of them. A variant has at most 65 such fingerprints, whatever the data,
so no group grows with the input; copies meet as one fingerprint beforehand. Components of the links are found by
alternating large-star and small-star steps, whose aggregates are partial sums of their keys.

``survivors`` links, besides, documents whose sets of WORDS-word shingles have a similarity (Jaccard) of SIMILARITY or
more. The search is exact: in one order of all shingles, common ones last, two such sets share one of their first
n - SIMILARITY * n + 1. Texts that share one are compared with the smallest of them; then, as far as they are not connected
yet, with the nearest of them, and in the end with all, so that no pair is left that is neither connected nor compared.
Pairs are compared by size and by a sketch that never differs in more bits than the sets in shingles, then on the whole sets.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, map_batches, one_of_each, releasing, staged
from .exchange import BASE, mixed, pack_counts, pack_sorted, slices, unpack_counts, unpack_sorted

#: Bits in which linked fingerprints may differ; even, as half of it is what each side gives.
RADIUS = 2
SHINGLE = 3
MAX_ROUNDS = 60
#: The similarity of whole sets of shingles from which ``survivors`` calls documents near copies.
WORDS, SIMILARITY = 5, 0.8
#: Longs of a set's sketch, of a set of more than LARGE shingles: a bit is the parity of the shingles that fall on it.
LANES, LARGE, WIDE = 8, 256, 64
#: Texts of the sample that tells common shingles, how often one is there to be common, and the most that are told. These
#: only set the order of shingles, and with it the cost: any order finds the same pairs.
SAMPLE, OFTEN, COMMON = 20_000, 3, 500_000
#: Parts that the sample's shingles are counted in, at least; hashes that are counted at once where the texts are read.
PARTS, HELD = 256, 1 << 19
#: Rows whose sets of shingles are held at once.
ROWS = 1000
#: Up to so many rows of a few numbers each go to all executors.
BROADCAST_ROWS = 100_000
#: Texts are compared with the nearest by sketch again while more than this share of such pairs are near copies.
AGAIN = 0.25
#: Rows of a bucket of shingles, about; texts of a shingle from which they are compared in blocks.
DEALT, BLOCK = 50_000, 4096


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text: bit i is set if it is in over half of the shingles' hashes."""
    import numpy as np
    import xxhash

    words = (data or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    counts, n, step, digest = np.zeros(64, np.int64), len(words) - shingle + 1, 1 << 15, xxhash.xxh64_digest
    for i in range(0, n, step):
        part = words[i : i + step + shingle - 1]
        joined, at, starts = b" ".join(part), 0, []
        for w in part:
            starts.append(at)
            at += len(w) + 1
        starts.append(at)
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long. Null text counts as empty: fingerprint zero."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], ["id", "fp"])

    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, fp long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u > v: of each variant, its fingerprints with the smallest of them; ``distinct`` has each fp once."""
    if radius != 2:
        raise ValueError("the ball is written out for a radius of 2: each side flips at most one bit")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    # a few bytes become 65 rows: so many tasks as shuffles have, not as few as so small a table would be read by
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    ball = spread.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = ball.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u > v")
    return pairs.filter(differing(F.col("u"), F.col("v")) <= radius).distinct()


def of_each(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` with what ``least`` (one row a node, at most ``rows``) says of their u. No task gathers a hot node: few
    rows are broadcast, of more those with many edges."""
    if rows <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least), "u")
    return hot_join(edges, least, "u", "degree", rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge are absent.

    Each round every node's greater neighbours are tied to its smallest one (large star), then its smaller ones
    (small star); rounds are staged tables, and end when the edges no longer change.
    """
    edges = staged(edges, "edges")
    mark, rows = None, edges.count()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "u"))
        large = of_each(both.filter("v > u"), least, 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u > v").distinct()
        small_least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = of_each(down, small_least, 2 * rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.filter("u > v").distinct(), "edges")
        # equal sets of edges have equal sums of two independent hashes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == mark:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark, rows = now, now[0]
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id: the smallest id reachable over links.

    Null and empty texts have fingerprint zero, and are linked like any other. Null ids are rows like others and
    never name a component unless all its ids are null. Repeated rows are repeated in the result. Other columns of
    ``docs`` are not looked at; an empty table gives an empty result.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(rooted.select("fp", "root", "least", "copies"), "rooted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "root").select("fp", "component_id", "copies")
    joined = hot_join(fps, staged(lookup, "lookup"), "fp", "copies", fps.count())
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(words: list[bytes], size: int):
    """Hashes of the distinct runs of ``size`` words, ascending; of fewer words, of the whole sequence; none: empty."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(BASE) + h[j : j + n])
    return np.unique(out)


def sketch(found):
    """LANES or WIDE unsigned longs: of each bit, the parity of the shingles on it. Two differ in no more bits than the
    sets do; a wide one folds (by XOR of its parts) to the one of LANES."""
    import numpy as np

    bits = 64 * (WIDE if len(found) > LARGE else LANES)
    at = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((at & 1).astype(np.uint8)).view(np.uint64)


def prefix(found, common, times, similarity: float = SIMILARITY):
    """(first shingles of a set, rare ones first; how many are near): two sets of the similarity share one that is near in
    the smaller set (either, of equal sizes) and among the first in the other."""
    import numpy as np

    if not len(found):
        return found, 0
    size = len(found) - math.ceil(similarity * len(found) - 1e-6) + 1
    near = len(found) - math.ceil(2 * similarity / (1 + similarity) * len(found) - 1e-6) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, times[at], 0), kind="stable")]
    return found[:size], near


def counted(sets, parts: int):
    """(part, hashes, counts) of all sets: distinct hashes ascending and how often each, packed a part of the hashes. What is
    held grows to HELD hashes, or one set of more, before it is packed."""
    import numpy as np

    held, n = [], 0

    def packed():
        found, times = np.unique(np.concatenate(held), return_counts=True)
        return [(part, pack_sorted(found[a:b]), pack_counts(times[a:b])) for part, a, b in slices(found, parts)]

    for found in sets:
        if n and n + len(found) > HELD:
            yield packed()
            held, n = [], 0
        if len(found):
            held.append(found)
            n += len(found)
    if held:
        yield packed()


def summed(packed):
    """(hashes ascending, how often each) of all of ``packed`` (hashes, counts)."""
    import numpy as np

    found, times = (np.concatenate(x) for x in zip(*[(unpack_sorted(h), unpack_counts(c)) for h, c in packed]))
    order = np.argsort(found, kind="stable")  # runs that are sorted already
    found, times = found[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.add.reduceat(times, first)


def common_shingles(docs: DataFrame, text_col: str):
    """(hashes ascending, how often each) of shingles that a sample of the texts has often.

    Nearly every shingle of the sample is there once, so they travel packed, some thousands a row: as rows of their own they
    fill the heaps of the executors.
    """
    import numpy as np

    every = max(1, docs.count() // SAMPLE)
    source = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(F.col(text_col).cast("binary").alias("text"))
    parts = max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        texts = (text for batch in small(batches) for text in batch.column(0))
        sets = (shingles((t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split(), WORDS) for t in texts)
        for rows in counted(sets, parts):
            part, hashes, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["part", "hashes", "counts"])

    def total(table):
        found, times = summed(zip(*(table.column(c).to_pylist() for c in ("hashes", "counts"))))
        often = times >= OFTEN
        return pa.table({"s": found[often].view(np.int64), "c": times[often]})

    often = map_batches(source, run, "part int, hashes binary, counts binary").groupBy("part").applyInArrow(releasing(total), "s long, c long")
    told = often.orderBy(F.desc("c"), "s").limit(COMMON).toArrow()
    found, times = (np.asarray(told.column(k).to_numpy(), np.int64) for k in (0, 1))
    found = found.view(np.uint64)
    order = np.argsort(found)
    return found[order], times[order]


def small(batches):
    """The rows of ``batches``, ROWS at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def set_digest(found) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    import numpy as np

    return int(mixed(found).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed(found ^ np.uint64(BASE)), initial=np.uint64(len(found))))


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of (x, y)."""
    return pairs.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, fp, a, b, n, near, sketch, prefix): of each row a hash of its text, its fingerprint, and of its set of
    shingles the digest, size, sketch and first shingles."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def run(batches):
        import numpy as np

        common, times = held.value
        for batch in small(batches):
            rows, sketches, first = np.zeros((batch.num_rows, 5), np.uint64), [], []
            for row, text in zip(rows, batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = shingles(data.lower().split(), WORDS)
                some, near = prefix(found, common, times)
                row[:] = fingerprint(data), *set_digest(found), len(found), near
                sketches.append(sketch(found).view(np.int64))
                first.append(some.view(np.int64))
            signed = rows.view(np.int64)
            columns = [pa.array(np.ascontiguousarray(signed[:, k])) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(sketches, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], ["id", "digest", "fp", "a", "b", "n", "near", "sketch", "prefix"])

    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, digest long, fp long, a long, b long, n long, near long, sketch array<long>, prefix array<long>")


def kept_keys(rows: DataFrame, lookup: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to ``lookup`` (one row a ``key``, which meets ``size`` rows): broadcast if it is small by
    count, else split as in ``hot_join``, so that no task gathers a hot key."""
    n, total = lookup.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), key)
    return hot_join(rows, lookup, key, size, total).filter(F.col(size).isNotNull())


def folded(sketch: Column) -> Column:
    """A sketch as LANES longs."""
    parts = [[sketch[i] for i in range(k, WIDE, LANES)] for k in range(LANES)]
    return F.when(F.size(sketch) == WIDE, F.array(*[functools.reduce(Column.bitwiseXOR, p) for p in parts])).otherwise(sketch)


def alike(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` whose sizes and sketches allow for the similarity: of n_u and n_v shingles in sets of the
    similarity, no more than (n_u + n_v) * (1 - similarity) / (1 + similarity) are in one only."""
    for end in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    u, v = F.col("sketch_u"), F.col("sketch_v")
    same = F.size(u) == F.size(v)
    bits = F.zip_with(F.when(same, u).otherwise(folded(u)), F.when(same, v).otherwise(folded(v)), differing)
    most = (F.col("n_u") + F.col("n_v")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    sized = F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-6
    return pairs.filter(sized).filter(F.aggregate(bits, F.lit(0), lambda x, y: x + y) <= most).select("u", "v")


def near_pairs(s, node, root, n, near, lanes, own, nearest: bool, similarity: float = SIMILARITY):
    """(u, v), u > v, of rows that share ``s``, of different roots, whose sizes and sketches allow for the similarity.

    ``own``: only rows of different values are compared; None: all. ``nearest``: each row's nearest by sketch only. In
    order of s and size, rows are compared with the next, the one after it, and so on, as long as any has one to compare.
    """
    import numpy as np

    order = np.lexsort((n, s))
    s, node, root, n, lanes = s[order], node[order], root[order], n[order], np.ascontiguousarray(lanes[order].T)
    own = None if own is None else own[order]
    share, far = (1 - similarity) / (1 + similarity), np.iinfo(np.int64).max
    best, partner = np.full(len(s), far), np.zeros(len(s), np.int64)
    active, found, step = np.flatnonzero(near[order]), [], 0
    while len(active):
        step += 1
        active = active[active + step < len(s)]
        there = active + step
        active = active[(s[there] == s[active]) & (n[active] >= similarity * n[there] - 1e-6)]
        open_ = root[active] != root[active + step]
        if own is not None:
            open_ &= own[active] != own[active + step]
        a = active[open_]
        b = a + step
        apart = np.zeros(len(a), np.int64)
        for lane in lanes:
            apart += np.bitwise_count(lane[a] ^ lane[b])
        good = apart <= (n[a] + n[b]) * share + 1e-6
        a, b, apart = a[good], b[good], apart[good]
        if nearest:
            for x, y in ((a, b), (b, a)):
                less = apart < best[x]
                best[x[less]], partner[x[less]] = apart[less], y[less]
        else:
            found.append((node[a], node[b]))
    if nearest:
        x = np.flatnonzero(best < far)
        found = [(node[x], node[partner[x]])]
    u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)


def compared(met: DataFrame, roots: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """(u, v): pairs of ``met`` (s, node, near) that share an s and aren't connected yet, as ``near_pairs`` has them.

    Shingles whose texts are all connected go first. The others are dealt to buckets of about DEALT rows; one of more
    than BLOCK texts is cut into blocks instead, and each two of its blocks are compared in a task of their own.
    """
    rooted = staged(met.select("s", "node", "near").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    live = staged(rooted.groupBy("s").agg(F.count("*").alias("times"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("s", "times"), "live")
    rows = kept_keys(rooted, live, "s", "times").join(nodes.select("node", "n", folded(F.col("sketch")).alias("sketch")), "node")
    total = live.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    buckets = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / DEALT))
    n_blocks = F.ceil(F.col("times") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    whole = F.array(F.struct(F.pmod(F.xxhash64("s"), F.lit(buckets)).alias("bucket"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.col("s").alias("bucket"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = rows.withColumn("own", own).withColumn("at", F.explode(F.when(n_blocks == 1, whole).otherwise(cut)))
    dealt = placed.select("at.bucket", "at.i", "at.j", "s", "own", "node", "root", "n", "near", "sketch")

    def run(table):
        import numpy as np

        s, node, root, n, near, own = (table.column(c).to_numpy() for c in ("s", "node", "root", "n", "near", "own"))
        lanes = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
        halves = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        u, v = near_pairs(s, node, root, n, near, lanes, own if halves else None, nearest)
        return pa.table({"u": u, "v": v})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(releasing(run), "u long, v long").distinct()


def connected(docs: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, root) over ``edges`` and the links of all pairs of the similarity.

    The texts of a first shingle are compared with the smallest of them; then each with the nearest that it isn't
    connected to, as long as that links many; then with all that are left. So every pair that shares one is connected or
    compared in the end, and texts that are alike are connected by a few pairs of each.
    """
    entries = nodes.select(F.posexplode("prefix").alias("at", "s"), "node", "near").select("s", "node", (F.col("at") < F.col("near")).alias("near"))
    counted = entries.groupBy("s").agg(F.count("*").alias("times"), F.min("node").alias("least"), F.max("near").alias("any"))
    shared = staged(counted.filter("times > 1 AND any").select("s", "times", "least"), "shared")
    met = staged(kept_keys(entries, shared, "s", "times").select("s", "node", "near", "least"), "met")
    star = met.filter("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    tried = staged(alike(star, nodes), "star")
    texts = Sets(docs, nodes, id_col, text_col)
    roots = staged(components(texts.similar(tried).unionByName(edges)), "components")
    nearest = True
    while True:
        pairs = staged(alike(compared(met, roots, nodes, nearest).join(tried, ["u", "v"], "left_anti"), nodes), "pairs")
        near, n = staged(texts.similar(pairs), "links"), pairs.count()
        linked = near.count()
        if linked:
            edges = roots.filter("node > root").select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = staged(components(near.unionByName(edges)), "components")
        if not nearest:
            return roots
        tried = tried.unionByName(pairs)
        nearest = linked > AGAIN * n


class Sets:
    """The whole sets of shingles of the texts that were asked for so far; no text is read for it twice."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str):
        self.docs, self.nodes, self.id_col, self.text_col = docs, nodes, id_col, text_col
        self.known: DataFrame | None = None

    def similar(self, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
        """Those of ``pairs`` whose whole sets have the similarity; only texts of pairs are moved."""
        sets = self._of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        for end in "uv":
            pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("found").alias(f"of_{end}")), end)
        shared = pairs.select("u", "v", F.size(F.array_intersect("of_u", "of_v")).alias("both"), (F.size("of_u") + F.size("of_v")).alias("sum"))
        return shared.filter(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("u", "v").distinct()

    def _of(self, asked: DataFrame) -> DataFrame:
        """(node, found)."""
        if self.known is not None:
            asked = asked.join(self.known.select("node"), "node", "left_anti")
        asked = staged(asked.join(self.nodes.select("node", "id", "digest", "a", "b"), "node"), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        own = self.docs.select(F.col(self.id_col).alias("_id"), F.xxhash64(self.text_col).alias("_digest"), F.col(self.text_col).cast("binary").alias("text"))
        met = own.join(asked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))).select("node", "text", "a", "b")

        def run(batches):
            import numpy as np

            for batch in small(batches):
                names, sets = [], []
                for node, text, a, b in zip(*[batch.column(k) for k in range(4)]):
                    found = shingles((text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split(), WORDS)
                    if set_digest(found) == (a.as_py() % (1 << 64), b.as_py() % (1 << 64)):
                        names.append(node.as_py())
                        sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "found"])

        # rows that repeat id and text repeat a node
        read = staged(map_batches(met, run, "node long, found array<long>"), "sets").dropDuplicates(["node"])
        self.known = read if self.known is None else self.known.unionByName(read)
        return self.known


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of near copies: the one of the smallest id.

    Documents are linked if their fingerprints are (as in ``near_dedup``), or if their sets of WORDS-word shingles have
    a similarity of SIMILARITY or more; texts without words are one group. A null id comes after all others, and of
    rows that repeat id and text the first by a hash of all columns stays. An empty table gives an empty result.
    """
    signed = staged(signatures(docs, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    classes = signed.groupBy("a", "b").agg(first, F.first(F.struct("n", "near", "sketch", "prefix")).alias("of"))
    # numbered where it is written, and only read from then on
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "first.*", "of.*"), "nodes")
    of = staged(signed.select("fp", "a", "b").distinct().join(nodes.select("a", "b", "node"), ["a", "b"]).select("fp", "node"), "prints")
    least = staged(of.groupBy("fp").agg(F.min("node").alias("least")), "least")
    same = of.join(least, "fp").filter("node > least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    close = links(least.select("fp"))
    for end, name in (("u", "x"), ("v", "y")):
        close = close.join(least.select(F.col("fp").alias(end), F.col("least").alias(name)), end)
    roots = connected(docs, nodes, staged(ordered(same.unionByName(close.select("x", "y"))), "edges"), id_col, text_col)
    lost = nodes.select("node", "no_id", "id", "digest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = lost.groupBy("root").agg(F.min(F.struct("no_id", "id", "digest")).alias("first")).select(F.struct("first.id", "first.digest").alias("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("key"))
    return one_of_each(rows, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
