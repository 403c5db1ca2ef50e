"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row becomes a digest record; records are dealt to RUNS runs, each reduced to one record a digest, sorted
by digest. The runs then merge FAN at a time, round by round, as in a binomial tree: a merge keeps, for each
digest, the smallest identifier under (longest original text first, then smallest id) and the number of copies.
Every round is dealt by (run, digest), so a digest that a third of all rows share reaches a merge as one record
a run, and no task gathers a group. Equality is verified by a digest of 256 bits together with the length and an
independent 64-bit hash of the normalised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, hot_join, one_of_each, staged

#: Leaf runs and how many of them merge in one round; both powers of two.
RUNS, FAN = 16, 4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_points, digest, check, norm_len): the digest record of each row; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_points"), F.translate(text, SPACES, "").alias("_bare"))
    return bare.select("id", "n_points", F.unhex(F.sha2("_bare", 256)).alias("digest"), F.xxhash64("_bare").alias("check"), F.octet_length("_bare").cast("long").alias("norm_len"))


def merge_runs(records: DataFrame) -> DataFrame:
    """One row a text: (digest, check, norm_len, keep_id, keep_points, group_size), by binomial rounds of run merges."""
    key = ["digest", "check", "norm_len"]
    best = F.struct((-F.col("n_points")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id"))
    runs = records.select(F.pmod(F.xxhash64("id", "n_points"), F.lit(RUNS)).alias("run"), *key, best.alias("best"), "copies")
    left = RUNS
    while left:
        runs = runs.groupBy("run", *key).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
        left //= FAN
        if left:
            runs = runs.withColumn("run", F.floor(F.col("run") / FAN))
    return runs.groupBy(*key).agg(F.min("best").alias("best"), F.sum("copies").alias("copies")).select(*key, F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_points"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty and white-space-only texts form one group. Null ids are kept as ids and sort
    last. Rows that repeat both id and text count as copies of one another; one of them is kept. Other columns of
    ``docs`` are not looked at. An empty table gives an empty result.
    """
    records = staged(digests(docs, id_col, text_col).groupBy("id", "n_points", "digest", "check", "norm_len").agg(F.count("*").alias("copies")), "digests")
    kept = staged(merge_runs(records), "winners")
    packed = lambda df: df.select(F.struct("digest", "check", "norm_len").alias("key"), *[c for c in df.columns if c not in ("digest", "check", "norm_len")])
    joined = hot_join(packed(records), packed(kept), "key", "group_size", records.count())
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_nth", "_"), first.alias("_first"), F.lower(F.hex("key.digest")).alias("text_sha256")).select(id_col, "keep_id", "group_size", (F.col("_first") & (F.col("_nth") == 0)).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    The join back is by id, digest and length, which it is hashed on, so the choice among rows that repeat these needs
    no further exchange.
    """
    records = digests(docs, id_col, text_col).withColumn("copies", F.lit(1).cast("long"))
    kept = merge_runs(records).select(F.struct(F.col("keep_id").alias("id"), "digest", F.col("keep_points").alias("points")).alias("key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"), F.char_length(text).cast("long").alias("points"))
    return one_of_each(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key")), kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), w AS (
  SELECT doc_id, h, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER g AS nth
  FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, h AS text_sha256 FROM w
"""
