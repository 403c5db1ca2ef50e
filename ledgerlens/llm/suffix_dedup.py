"""Removal of repeated byte strings by a distributed merge of front-coded sorted suffix runs.

A string of LENGTH bytes that occurs twice has, at both places, the same anchor: the smallest hash of its SEED-byte
parts. It holds the K bytes from the anchor on, or else the K bytes that end where the anchor's SEED bytes end (K is
half of LENGTH and SEED together). So only suffixes that begin at either place are sorted, and a pair of suffixes
matters only if it shares K bytes; a common sentence shorter than that brings nothing together.

1. Every chunk of documents sends the hashes of these places (of the K bytes, and of all that LENGTH-byte strings
   around them can reach) to the bucket of the K bytes. Where the whole surroundings repeat, the bucket answers
   that everything there is repeated; where K bytes repeat in several surroundings, one chunk is asked for each.
2. Those suffixes are exchanged as front-coded sorted runs and combined in the bucket by a loser tree that compares
   lengths of common prefixes, and characters only beyond them. In the merged order suffixes with K bytes in common
   stand together; of each, the strings around the anchor that occur in another surrounding are found and compared
   byte by byte, and the reach of the repeated bytes to both sides of the anchor is answered.
3. Every chunk cuts the repeated bytes out of its texts.

Strings are judged on the input, and matches don't cross documents. Equality of whole surroundings rests on two
64-bit hashes; everything else is compared as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .exchange import BASE, Prefixes, blocks, dealt, mixed, pack_sorted, slices, texts, unpack_sorted

LENGTH, SEED = 200, 32
BLOCK = 1 << 18
_PREFIXES = Prefixes()
#: Answers of the first round, as bits: the whole surroundings repeat; send the suffix.
WHOLE, SEND = 1, 2


def shared(length: int) -> int:
    """K: the bytes that suffixes must have in common to matter to each other."""
    return (length + SEED) // 2


def anchors(b, starts, length: int = LENGTH, k: int = SEED):
    """Positions of the anchors of a block of texts that begin and end at ``starts``."""
    if len(b) < length:
        return np.zeros(0, np.int64)
    h, power, n = b.astype(np.uint64) + np.uint64(1), BASE, 1
    while n < k:  # k is a power of two
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    h = mixed(h)
    w = length - k + 1
    least = _slide(h, w, np.minimum)
    # windows count only if they lie in one text
    whole = np.zeros(len(least) + 1, np.int32)
    lengths = np.diff(starts)
    np.add.at(whole, starts[:-1][lengths >= length], 1)
    np.add.at(whole, (starts[1:] - length + 1)[lengths >= length], -1)
    least[np.cumsum(whole[:-1]) == 0] = 0
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum) == h)


def _slide(x, w: int, least):
    """The least (or greatest) of each w in a row."""
    n = 1
    while 2 * n <= w:
        x, n = least(x[:-n], x[n:]), 2 * n
    return least(x[: -(w - n)], x[w - n :]) if w > n else x


class Chunk:
    """The places of a chunk's texts: by text and offset, with the number of their (K bytes, surroundings) pair."""

    def __init__(self, parts: list, length: int = LENGTH):
        k = shared(length)
        self.parts, self.length = parts, length
        owner, offset, inner, outer, left, right = [], [], [], [], [], []
        for first, b, starts in blocks(parts, BLOCK):
            at = anchors(b, starts, length)
            text = np.searchsorted(starts, at, side="right") - 1
            back = at - (length - k)
            at, text = np.concatenate([at, back]), np.concatenate([text, text])
            inside = (at >= starts[text]) & (at + k <= starts[text + 1])
            at, first_of = np.unique(at[inside], return_index=True)
            text = text[inside][first_of]
            if not len(at):
                continue
            l = np.minimum(at - starts[text], length - k)
            r = np.minimum(starts[text + 1] - at, length)
            sums = _PREFIXES.sums(b)
            for box, x in ((owner, first + text), (offset, at - starts[text]), (inner, _PREFIXES.hashes(sums, at, at + k)), (left, l), (right, r), (outer, mixed(_PREFIXES.hashes(sums, at - l, at + r) + l.astype(np.uint64) * np.uint64(BASE)))):
                box.append(x)
        joined = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.owner, self.offset, self.left, self.right = (joined(x, np.int64) for x in (owner, offset, left, right))
        inner, outer = joined(inner, np.uint64), joined(outer, np.uint64)
        order = np.lexsort((outer, inner))
        i, o = inner[order], outer[order]
        new = np.ones(len(order), bool)
        new[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1])
        self.inner, self.outer, self.first = i[new], o[new], order[new]
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.several = np.bincount(self.pair, minlength=len(self.first)) > 1

    def surroundings(self, pairs):
        """(bytes to the left, bytes from the anchor on) of one anchor of each pair."""
        for j in self.first[pairs].tolist():
            t, at = self.parts[self.owner[j]], int(self.offset[j])
            yield bytes(t[at - int(self.left[j]) : at]), bytes(t[at : at + int(self.right[j])])


def _asked(table: pa.Table, n_buckets: int, length: int) -> pa.Table:
    chunk, own = table.column("chunk")[0].as_py(), Chunk(texts(table), length)
    rows = [(bucket, chunk, a, pack_sorted(own.inner[a:b]), own.outer[a:b].tobytes(), np.packbits(own.several[a:b]).tobytes()) for bucket, a, b in slices(own.inner, n_buckets)]
    kinds = (("bucket", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("inner", pa.binary()), ("outer", pa.binary()), ("several", pa.binary()))
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def _matched(table: pa.Table) -> pa.Table:
    """The first round's answers: one code for each pair that a chunk sent."""
    inner = [unpack_sorted(x) for x in table.column("inner").to_pylist()]
    sizes = [len(x) for x in inner]
    outer = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("outer").to_pylist()])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("several").to_pylist(), sizes)])
    chunk = np.repeat(np.asarray(table.column("chunk")), sizes)
    i = np.concatenate(inner)
    order = np.lexsort((chunk, outer, i))
    i, o, s = i[order], outer[order], several[order]
    new_i = np.ones(len(i), bool)
    new_i[1:] = i[1:] != i[:-1]
    new = new_i.copy()
    new[1:] |= o[1:] != o[:-1]
    of_pair, of_key = np.cumsum(new) - 1, np.cumsum(new_i) - 1
    whole = (np.bincount(of_pair) > 1) | (np.bincount(of_pair, weights=s) > 0)
    pairs = np.bincount(of_key[new])  # surroundings of each key
    open_ = np.bincount(of_key[new], weights=~whole) > 0  # some of which don't repeat as a whole
    code = np.empty(len(i), np.uint8)
    code[order] = whole[of_pair] * WHOLE + (new & (pairs > 1)[of_key] & open_[of_key]) * SEND
    edges = np.cumsum([0, *sizes])
    codes = [code[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"chunk": table.column("chunk"), "start": table.column("start"), "codes": pa.array(codes, pa.binary())})


def _codes(answers: pa.Table, n: int):
    code = np.zeros(n, np.uint8)
    for start, data in zip(answers.column("start").to_pylist(), answers.column("codes").to_pylist()):
        if data is not None:
            code[start : start + len(data)] = np.frombuffer(data, np.uint8)
    return code


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` at least."""
    n = min(len(a), len(b))
    while at < n:
        step = min(32, n - at)
        if a[at : at + step] == b[at : at + step]:
            at += step
            continue
        x = int.from_bytes(a[at : at + step], "big") ^ int.from_bytes(b[at : at + step], "big")
        return at + step - (x.bit_length() + 7) // 8
    return n


def front_coded(rows: list[tuple[bytes, bytes, int, bool]]) -> bytes:
    """A sorted run of (suffix, bytes to its left, number, whole): each suffix without what it shares with the one before."""
    import zstandard

    lcp, tails, before = [], [], b""
    for suffix, _, _, _ in rows:
        n = common(before, suffix)
        lcp.append(n)
        tails.append(suffix[n:])
        before = suffix
    head = np.array([[a, len(t), len(r[1])] for a, t, r in zip(lcp, tails, rows)], np.uint8)
    numbers = np.array([r[2] for r in rows], np.uint32)
    flags = np.array([r[3] for r in rows], np.uint8)
    raw = len(rows).to_bytes(4, "little") + head.tobytes() + numbers.tobytes() + flags.tobytes() + b"".join(tails) + b"".join(r[1] for r in rows)
    return zstandard.compress(raw, 1)


class Run:
    """A front-coded run as a stream: the head suffix and its common prefix with the one before."""

    def __init__(self, source: int, data: bytes):
        import zstandard

        raw = zstandard.decompress(data)
        n = int.from_bytes(raw[:4], "little")
        self.source, self.n, self.i = source, n, -1
        at = 4
        self.head = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(-1, 3).tolist()
        self.numbers = np.frombuffer(raw, np.uint32, n, at := at + 3 * n).tolist()
        self.flags = np.frombuffer(raw, np.uint8, n, at := at + 4 * n).tolist()
        self.raw, self.tail = raw, at + n
        self.left_at = self.tail + sum(h[1] for h in self.head)
        self.suffix = b""
        self.lcp = 0
        self.next()

    def next(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            self.suffix = None
            return False
        lcp, tail, left = self.head[self.i]
        self.suffix = self.suffix[:lcp] + self.raw[self.tail : self.tail + tail]
        self.left = self.raw[self.left_at : self.left_at + left]
        self.tail, self.left_at, self.lcp = self.tail + tail, self.left_at + left, lcp
        return True


def merge(runs: list[Run]):
    """(common prefix with the one before, suffix, left, source, number, whole) of all runs, sorted, by a loser tree.

    Each inner node holds the stream that lost there and its common prefix with the winner that passed. The next
    contest is between a stream and losers whose prefixes refer to the same winner: the longer prefix is the smaller suffix; only at equal
    prefixes are characters compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [*runs, *[None] * (k - len(runs))]
    lcps = [0] * k
    losers: list[int] = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = streams[a], streams[b]
        if y is None or y.suffix is None:
            return a, b
        if x is None or x.suffix is None:
            return b, a
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        p, q = x.suffix, y.suffix
        n = common(p, q, lcps[a])
        if n == len(p) or (n < len(q) and p[n] < q[n]):
            lcps[b] = n
            return a, b
        lcps[a] = n
        return b, a

    winners = list(range(k)) if k == 1 else [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while (s := streams[top]) is not None and s.suffix is not None:
        yield lcps[top], s.suffix, s.left, s.source, s.numbers[s.i], s.flags[s.i]
        s.next()
        lcps[top] = s.lcp
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def reach(rows: list[tuple[bytes, bytes, bool]], length: int, k: int, base: int = BASE):
    """For (suffix, left, whole) rows: how far the repeated bytes reach to the left and to the right of the anchor.

    Of each string of ``length`` bytes that holds the anchor at offset j the hash is compared among all rows; a row
    of which one is met again gets the reach of its outermost ones, which are compared as bytes. (0, 0): none.
    """
    n, w = len(rows), length - k + 1
    text = np.zeros((n, length - k + length), np.uint8)
    for i, (suffix, left, _) in enumerate(rows):
        text[i, w - 1 - len(left) : w - 1 + len(suffix)] = np.frombuffer(left + suffix, np.uint8)
    lefts, rights = np.array([len(r[1]) for r in rows]), np.array([len(r[0]) for r in rows])
    whole = np.array([r[2] for r in rows], bool)
    powers = np.cumprod(np.full(text.shape[1], base, np.uint64))
    value = mixed(np.arange(1, 257, dtype=np.uint64))
    now = np.zeros(n, np.uint64)  # of the bytes from j on
    for i in range(length):
        now += value[text[:, i]] * powers[i]
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high = np.full(n, w, np.int64), np.full(n, -1, np.int64)
    mate_low, mate_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(w):  # the string begins w - 1 - j bytes to the left of the anchor
        if j:
            now += value[text[:, j + length - 1]] * powers[j + length - 1] - value[text[:, j - 1]] * powers[j - 1]
        some = np.flatnonzero((lefts >= w - 1 - j) & (rights >= length - (w - 1 - j)))
        if len(some) < 2:
            continue
        h = mixed(now[some])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if not same.any():
            continue
        x, y = some[order[1:][same]], some[order[:-1][same]]
        for p, q in ((x, y), (y, x)):
            first = low[p] > j
            low[p[first]], mate_low[p[first]] = j, q[first]
            high[p], mate_high[p] = j, q
    hit = np.flatnonzero((high >= 0) & ~whole)
    columns = np.arange(length)
    for ends, mates in ((low, mate_low), (high, mate_high)):
        at = ends[hit][:, None] + columns
        if (text[hit[:, None], at] != text[mates[hit][:, None], at]).any():  # two strings of one hash: take another
            return reach(rows, length, k, base + 2)
    a[hit], b[hit] = w - 1 - low[hit], length - (w - 1 - high[hit])
    return a, b


#: Suffixes that are compared at once in a bucket; a group of one K-byte prefix that is larger is compared whole.
ROWS_AT_ONCE = 20_000


def _merged(table: pa.Table, length: int) -> pa.Table:
    """The second round's answers: of each suffix with a partner, its number and the reach to both sides."""
    runs = [Run(c, d) for c, d in zip(table.column("chunk").to_pylist(), table.column("run").to_pylist())]
    out: dict[int, list] = {}

    def settle(rows: list) -> None:
        a, b = reach([(r[0], r[1], r[4]) for r in rows], length, shared(length))
        for r, x, y in zip(rows, a.tolist(), b.tolist()):
            if y:
                out.setdefault(r[2], []).append((r[3], x, y))

    group: list = []
    held: list = []
    for lcp, *row in merge(runs):
        if lcp < shared(length):
            if len(group) > 1:
                held += group
                if len(held) >= ROWS_AT_ONCE:
                    settle(held)
                    held = []
            group = []
        group.append(row)
    if len(group) > 1:
        held += group
    if held:
        settle(held)
    return pa.table({"chunk": pa.array(list(out), pa.int32()), "start": pa.array([0] * len(out), pa.int64()), "codes": pa.array([None] * len(out), pa.binary()), "reach": pa.array([np.array(x, np.int64).tobytes() for x in out.values()], pa.binary())})


def _sent(table: pa.Table, answers: pa.Table, n_buckets: int, length: int) -> pa.Table:
    if not table.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "run": pa.array([], pa.binary())})
    chunk, own = table.column("chunk")[0].as_py(), Chunk(texts(table), length)
    asked = np.flatnonzero(_codes(answers, len(own.inner)) & SEND)
    whole = (_codes(answers, len(own.inner)) & WHOLE) > 0
    rows = []
    for bucket, a, b in slices(own.inner[asked], n_buckets):
        some = asked[a:b]
        run = sorted((suffix, left, int(p), bool(whole[p])) for p, (left, suffix) in zip(some, own.surroundings(some)))
        rows.append((bucket, chunk, front_coded(run)))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "run": pa.array([r[2] for r in rows], pa.binary())})


def _cut(table: pa.Table, answers: pa.Table, length: int, id_type) -> pa.Table:
    own = Chunk(texts(table), length)
    code = _codes(answers, len(own.inner))
    a, b = np.zeros(len(own.inner), np.int64), np.zeros(len(own.inner), np.int64)
    for data in answers.column("reach").to_pylist():
        if data is not None:
            got = np.frombuffer(data, np.int64).reshape(-1, 3)
            a[got[:, 0]], b[got[:, 0]] = got[:, 1], got[:, 2]
    whole = (code & WHOLE) > 0
    left = np.where(whole[own.pair], own.left, a[own.pair])
    right = np.where(whole[own.pair], own.right, b[own.pair])
    hit = left + right >= length
    owner, lo, hi = own.owner[hit], (own.offset - left)[hit], (own.offset + right)[hit]
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    edges = np.searchsorted(owner, np.arange(len(own.parts) + 1))
    kept, n_bytes, removed, spans = [], [], [], []
    for i, text in enumerate(own.parts):
        n_bytes.append(len(text))
        x, y = edges[i], edges[i + 1]
        if x == y:
            kept.append(bytes(text))
            removed.append(0)
            spans.append(0)
            continue
        upto = np.maximum.accumulate(hi[x:y])
        new = np.ones(y - x, bool)
        new[1:] = lo[x + 1 : y] > upto[:-1]  # touching runs are one
        begins, ends = lo[x:y][new], upto[np.append(np.flatnonzero(new)[1:] - 1, y - x - 1)]
        pieces, at = [], 0
        for s, e in zip(begins.tolist(), ends.tolist()):
            pieces.append(text[at:s])
            at = e
        pieces.append(text[at:])
        kept.append(b"".join(pieces))
        removed.append(int((ends - begins).sum()))
        spans.append(len(begins))
    columns = {"id": table.column("id").cast(id_type), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
    return pa.table(columns)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, kept (the bytes left of its text), n_bytes, n_removed, n_spans.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text
    or another. Null text counts as empty; texts shorter than ``length`` stay as they are. Repeated rows repeat
    their texts, so all of them are cut; null ids are kept; an empty table gives no rows.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    parts, n = dealt(docs, id_col, text_col, n_bytes)
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = dict(parts.dtypes)["id"], to_arrow_type(parts.schema["id"].dataType)
    chunks = parts.groupBy("chunk")
    asked = chunks.applyInArrow(lambda t: _asked(t, n, length), "bucket int, chunk int, start long, inner binary, outer binary, several binary")
    # as many tasks as buckets: left to themselves, small shuffles are put together by size, which isn't what they cost
    matched = asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_matched, "chunk int, start long, codes binary")
    sent = chunks.cogroup(matched.groupBy("chunk")).applyInArrow(lambda t, m: _sent(t, m, n, length), "bucket int, chunk int, run binary")
    reached = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _merged(t, length), "chunk int, start long, codes binary, reach binary")
    answers = matched.withColumn("reach", F.lit(None).cast("binary")).unionByName(reached)
    done = chunks.cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, m: _cut(t, m, length, id_type), f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
