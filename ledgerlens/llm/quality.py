"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are rows labelled good; the unlabelled set is web text as it comes, good and bad. With the class
prior pi, the risk pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)]) is minimised: the bracket estimates the
loss on the unseen negatives without bias, and is not let fall below zero, which is what an overfitted model would
do to it. The model is a small network over figures of a text's form (shares of characters, repetition of words and
lines, lengths). It is fitted on bounded samples, and scores every whole text where it is read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, map_batches

#: Expected numbers of trusted positives and of unlabelled texts that the model is fitted on; tables with fewer rows
#: are used whole.
POSITIVES, UNLABELLED = 12_000, 12_000
HIDDEN, EPOCHS, RATE, DECAY = 16, 500, 0.02, 1e-4
FOLDS, HELD_OUT = 3, 1
#: The prior where labels can't tell: nothing is labelled bad, or good.
DEFAULT_PRIOR = 0.85
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = len(PUNCTUATION) + 14


def features(data: bytes):
    """Figures of a whole text's form, each about between 0 and 3; an empty text has zeros."""
    import numpy as np

    out = np.zeros(N_FEATURES)
    if not data:
        return out
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[: len(PUNCTUATION)] = np.sqrt(counts[list(PUNCTUATION)] / n)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    m = len(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    out[len(PUNCTUATION) :] = (
        np.sqrt(upper / max(1, upper + lower)), np.sqrt(counts[48:58].sum() / n), np.sqrt(counts[128:].sum() / n), np.sqrt((counts[:32].sum() - counts[9:14].sum() + counts[127]) / n),
        counts[9:14].sum() / n + counts[32] / n, np.log1p(n) / 8, np.log1p(m) / 6, np.log1p((n - counts[32]) / max(1, m)) / 2,
        np.sqrt(again / max(1, m - 1)), len(set(words)) / max(1, m), np.log1p(m) / 6 * (1 - len(set(words)) / max(1, m)), np.sqrt(1 - len(set(lines)) / max(1, len(lines))), np.log1p(n / max(1, len(lines))) / 8, np.sqrt(counts[list(b".,")].sum() / max(1, m)),
    )
    return out


class Model:
    """A network with one hidden layer; score() is the probability that a text is good."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def score(self, x):
        import numpy as np

        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def fit(positive, unlabelled, prior: float, seed: int = 7) -> Model:
    """Minimises the non-negative risk with the logistic loss, by Adam over all rows at once."""
    import numpy as np

    x = np.concatenate([positive, unlabelled])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    n = len(positive)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        g = h @ p[2] + p[3]
        good = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # logistic loss: l(+) = log(1 + e^-g), l(-) = log(1 + e^g); their slopes in g are good - 1 and good
        as_negative = np.logaddexp(0, g)
        rest = as_negative[n:].mean() - prior * as_negative[:n].mean()
        slope = np.empty(len(z))
        if rest >= 0:
            slope[:n] = prior * (good[:n] - 1) / n - prior * good[:n] / n
            slope[n:] = good[n:] / (len(z) - n)
        else:  # step back: raise the bracket instead of lowering it
            slope[:n], slope[n:] = prior * good[:n] / n, -good[n:] / (len(z) - n)
        dh = slope[:, None] * p[2] * (1 - h * h)
        grads = [z.T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ slope + DECAY * p[2], np.array([slope.sum()])]
        for a, d, m, v in zip(p, grads, first, second):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *p)


def _featured(rows: DataFrame) -> DataFrame:
    """(id, text as binary) to (id, x)."""

    def run(batches):
        for batch in batches:
            xs = [features(t.as_buffer().to_pybytes() if t.is_valid else b"").tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.list_(pa.float64()))], ["id", "x"])

    return map_batches(rows, run, f"id {dict(rows.dtypes)['id']}, x array<double>")


def _some(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """Rows whose hash lies below most / n: a fixed sample of about ``most`` rows, all of them if there are no more."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The model, learnt from rows that are not held out; None without a trusted positive or without text.

    Of a document with several labels the worst counts; null ids, labels and texts don't. The prior is estimated as
    the share of good rows among the labelled ones, smoothed.
    """
    import numpy as np

    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not good:
        return None
    prior = (good + 1) / (n + 2) if good < n else DEFAULT_PRIOR
    # a bounded sample of ids, so it can be broadcast
    trusted = F.broadcast(_some(known.filter("label = 1").select("id"), "id", good, POSITIVES))
    text = docs.filter(F.col(text_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT)).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    both = text.join(trusted.withColumn("trusted", F.lit(True)), "id", "left")
    rows = docs.count()
    drawn = F.lit(True) if rows <= UNLABELLED * 2 else F.pmod(F.xxhash64(F.col("id"), F.lit("web")), F.lit(1_000_000)) < int(1_000_000 * UNLABELLED / (rows * 2 / 3))
    chosen = both.withColumn("web", drawn).filter("trusted OR web")
    tagged = chosen.select(F.struct("id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "web").alias("id"), "text")
    found = sorted(_featured(tagged).collect(), key=lambda r: (str(r.id.id), list(r.x)))
    p = [r.x for r in found if r.id.trusted]
    u = [r.x for r in found if r.id.web]
    if not p or not u:
        return None
    return fit(np.array(p), np.array(u), min(0.98, max(0.02, prior)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null text counts as empty; without a model every score is 0.5."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        import numpy as np

        for batch in batches:
            if model is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = model.score(np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]).reshape(batch.num_rows, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= 0.5).

    Null ids count as the empty text for the fold; repeated rows are scored alike; an empty table gives no rows.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns; scored and kept in one pass."""
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]).reshape(batch.num_rows, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
