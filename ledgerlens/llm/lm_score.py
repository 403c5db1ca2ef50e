"""LM scoring by stupid backoff over the corpus itself.

The count tables of n-grams of each order are partitioned by hash. Every chunk of documents (made where they are read)
explodes its texts into n-grams, pre-aggregates them, and joins the tables by sending each bucket its sorted n-grams with
their counts; the bucket sums over all chunks and answers with the totals. A document is scored by what the rest of the corpus
holds: its own occurrences are taken off every count. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, releasing
from .exchange import CHUNK_BYTES, Prefixes, blocks, chunked, mixed, pack_counts, pack_sorted, rows_of, slices, texts, unpack_counts, unpack_sorted

ORDER, BACKOFF = 3, 0.4
#: The count that stands for none at the last order.
UNSEEN = 0.5
BLOCK = 1 << 20
#: Bytes of text whose n-grams are pre-aggregated together, at most.
CHUNK = 3 * CHUNK_BYTES // 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PREFIXES = Prefixes()


def word_hashes(parts: list):
    """(hash of each word, number of its text): words are runs of non-space bytes, A-Z in lower case."""
    hashes, owner = [], []
    for first, raw, starts in blocks(parts, BLOCK):
        b = _LOWER[raw]
        word = ~_SPACE[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[starts[:-1][starts[:-1] < len(b)]] |= word[starts[:-1][starts[:-1] < len(b)]]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = starts[1:][starts[1:] > 0] - 1
        ends[last] |= word[last]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes.append(_PREFIXES.hashes(_PREFIXES.sums(b), s, e))
        owner.append(first + np.searchsorted(starts, s, side="right") - 1)
    return (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def grams(words, owner, order: int):
    """[(hashes, index of the last word)] for each order from 1 on; n-grams don't cross texts."""
    out, h = [(words, np.arange(len(words)))], words
    for n in range(2, order + 1):
        h = mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[n - 1 :] + np.uint64(n))
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        out.append((h[whole], np.flatnonzero(whole) + n - 1))
    return out


def _asked(table: pa.Table, n_buckets: int, order: int) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    rows: list[tuple] = []
    for n, (hashes, _) in enumerate(grams(*word_hashes(texts(rows_of(table))), order)):
        distinct, counts = np.unique(hashes, return_counts=True)
        for bucket, a, b in slices(distinct, n_buckets):
            rows.append((n * n_buckets + bucket, chunk, pack_sorted(distinct[a:b]), pack_counts(counts[a:b])))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})


def _answered(table: pa.Table) -> pa.Table:
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    every = np.concatenate(keys)
    _, at = np.unique(every, return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])).astype(np.int64)[at]
    edges = np.cumsum([0, *map(len, keys)])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "totals": pa.array([pack_counts(totals[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def _scored(table: pa.Table, answers: pa.Table, n_buckets: int, order: int, corpus: int, id_type) -> pa.Table:
    table = rows_of(table)
    m = table.num_rows
    words, owner = word_hashes(texts(table))
    tokens = np.bincount(owner, minlength=m)
    by_bucket = sorted(zip(answers.column("bucket").to_pylist(), range(answers.num_rows)))
    packed = answers.column("totals")
    levels = []
    for n, (hashes, last) in enumerate(grams(words, owner, order)):
        distinct, at = np.unique(hashes, return_inverse=True)
        got = [unpack_counts(packed[i].as_py()) for b, i in by_bucket if n * n_buckets <= b < (n + 1) * n_buckets]
        totals = np.concatenate(got) if got else np.zeros(0, np.int64)
        # less the text's own occurrences
        pair = owner[last] * max(1, len(distinct)) + at
        _, where, own = np.unique(pair, return_inverse=True, return_counts=True)
        rest = np.zeros(len(words), np.int64)
        rest[last] = totals[at] - own[where]
        levels.append(rest)
    others = np.maximum(corpus - tokens, 1)[owner] if len(owner) else np.zeros(0)
    value = np.log(np.maximum(levels[0], UNSEEN) / others)
    level = np.zeros(len(words), np.int64)
    value += (np.minimum(_position(owner), order - 1)) * np.log(BACKOFF)
    for n in range(1, order):
        hit = levels[n] > 0
        before = np.concatenate([np.ones(1, np.int64), levels[n - 1][:-1]])
        steps = np.minimum(_position(owner), order - 1) - n
        value = np.where(hit, np.log(np.maximum(levels[n], 1) / np.maximum(before, 1)) + steps * np.log(BACKOFF), value)
        level = np.where(hit, n, level)
    total = np.bincount(owner, weights=value, minlength=m)
    longest = np.bincount(owner, weights=level == order - 1, minlength=m)
    mean = pa.array(np.where(tokens > 0, total / np.maximum(tokens, 1), np.nan), pa.float64(), from_pandas=True)
    return pa.table({"id": table.column("id").cast(id_type), "n_tokens": pa.array(tokens, pa.int64()), "n_longest": pa.array(longest.astype(np.int64), pa.int64()), "log_score": pa.array(total, pa.float64()), "mean_log_score": mean})


def _position(owner):
    """Of each word, its place in its text, from 0."""
    if not len(owner):
        return owner
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_longest (words scored at the full order), log_score (the sum of the
    natural logarithms), mean_log_score.

    The score of a word after its context is the count of the n-gram over that of its context, at the longest order
    whose n-gram the other documents have; each order less (of those that the text has words for) costs a factor of
    BACKOFF. A word that no other document has counts UNSEEN. Null and empty texts have 0 words, log_score 0 and no
    mean. Rows that repeat an id are documents of their own; null ids are kept; an empty table gives no rows.
    """
    text = F.col(text_col)
    n_bytes, corpus = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()
    parts = chunked(docs, id_col, text_col, n_bytes, CHUNK)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / CHUNK_BYTES))
    kind, id_type = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    asked = parts.groupBy("chunk").applyInArrow(releasing(lambda t: _asked(t, n, order)), "bucket int, chunk long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(releasing(_answered), "chunk long, bucket int, totals binary")
    done = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        releasing(lambda t, a: _scored(t, a, n, order, corpus, id_type)), f"id {kind}, n_tokens long, n_longest long, log_score double, mean_log_score double")
    return done.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(documents(spark, sf_dir))
    return done.select("doc_id", "n_tokens", "n_longest", F.round("mean_log_score", 5).alias("mean_log_score"))


def _sql(order: int = ORDER) -> str:
    """w0 is a word, w1 the one before it, and so on; oN counts the n-grams of each text, eN those in all others."""
    ws = [", ".join(f"w{k}" for k in range(n)) for n in range(order + 1)]
    on = lambda t, n, shift=0: f"{t}.r = b.r AND " + " AND ".join(f"{t}.w{k} = b.w{k + shift}" for k in range(n))
    tables = "".join(f",\no{n} AS (SELECT r, {ws[n]}, count(*) AS c FROM b WHERE w{n - 1} IS NOT NULL GROUP BY r, {ws[n]}), e{n} AS (SELECT r, {ws[n]}, u.c - o{n}.c AS c FROM o{n} JOIN (SELECT {ws[n]}, sum(c) AS c FROM o{n} GROUP BY {ws[n]}) u USING ({ws[n]}))" for n in range(1, order + 1))
    joins = "".join(f"\n  LEFT JOIN e{n} ON {on(f'e{n}', n)}" for n in range(1, order + 1)) + "".join(f"\n  LEFT JOIN e{n} AS v{n} ON {on(f'v{n}', n, 1)}" for n in range(1, order))
    back = lambda n: f" + (least(i, {order}) - {n}) * ln({BACKOFF})" if n < order else ""
    cases = "".join(f"\n      WHEN e{n}.c > 0 THEN ln(e{n}.c / v{n - 1}.c){back(n)}" for n in range(order, 1, -1))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT r, i, w0, {", ".join(f"lag(w0, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, order))} FROM t){tables},
n AS (SELECT count(*) AS c FROM t), m AS (SELECT r, count(*) AS c FROM t GROUP BY r),
s AS (
  SELECT b.r, CASE{cases}
      ELSE ln(greatest(e1.c, {UNSEEN}) / greatest(n.c - m.c, 1)){back(1)} END AS x,
    CASE WHEN e{order}.c > 0 THEN 1 ELSE 0 END AS hit
  FROM b JOIN m ON m.r = b.r CROSS JOIN n{joins}
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(coalesce(sum(hit), 0) AS BIGINT) AS n_longest, round(avg(x), 5) AS mean_log_score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, doc_id, ws
"""


SQL = _sql()
