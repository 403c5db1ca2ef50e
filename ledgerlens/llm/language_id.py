"""Language identification by multilingual mixture inference.

A text is taken as a mixture of languages, its n-grams as drawn from the mixture. Expectation-maximisation estimates
each text's proportions from the n-gram likelihoods of the languages; then the set of languages is chosen by
penalised likelihood: the language of least share goes as long as the likelihood, less a penalty a language, does
not fall. The answer is the language of largest share. N-gram counts come from labelled texts that are not held out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, map_batches

#: Expected number of labelled texts that the likelihoods are learnt from, a language; all if there are no more.
TEXTS_A_LANGUAGE = 3_000
#: Hash buckets of byte trigrams, and how many of them, the most telling, are kept.
BUCKETS, TELLING = 1 << 16, 2048
SMOOTH, ROUNDS, LESS_ROUNDS, LEAST_SHARE = 0.5, 12, 6, 0.02
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
BATCH = 64


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str):
    """Bucket of each byte trigram of the lower-cased text; bytes other than letters are one space."""
    import numpy as np

    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class Model:
    """languages: sorted; index: bucket to kept gram or -1; p: kept grams by languages; prior: of languages."""

    def __init__(self, languages, index, p, prior):
        self.languages, self.index, self.p, self.prior = languages, index, p, prior

    def counts(self, texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), self.p.shape[0]))
        for i, t in enumerate(texts):
            kept = self.index[grams(t)]
            out[i] = np.bincount(kept[kept >= 0], minlength=self.p.shape[0])
        return out

    def proportions(self, c):
        """Shares of the languages in each row of counts, zero outside the chosen set."""
        import numpy as np

        def em(theta, rounds):
            for _ in range(rounds):
                mix = theta @ self.p.T
                theta = theta * ((c / np.maximum(mix, 1e-300)) @ self.p)
                theta /= np.maximum(theta.sum(axis=1, keepdims=True), 1e-300)
            return theta, (c * np.log(np.maximum(theta @ self.p.T, 1e-300))).sum(axis=1)

        n = c.sum(axis=1)
        penalty = np.log(np.maximum(n, 2))
        theta, _ = em(np.repeat(self.prior[None, :], len(c), axis=0), ROUNDS)
        theta[theta < LEAST_SHARE] = 0
        theta, fit = em(theta / np.maximum(theta.sum(axis=1, keepdims=True), 1e-300), LESS_ROUNDS)
        while True:
            several = (theta > 0).sum(axis=1) > 1
            if not several.any():
                return theta, n
            least = np.where(theta > 0, theta, np.inf).argmin(axis=1)
            fewer = theta.copy()
            fewer[np.flatnonzero(several), least[several]] = 0
            fewer, less = em(fewer / np.maximum(fewer.sum(axis=1, keepdims=True), 1e-300), LESS_ROUNDS)
            better = several & (less + penalty >= fit)
            if not better.any():
                return theta, n
            theta[better], fit[better] = fewer[better], less[better]

    def predict(self, texts: list[str | None]):
        """(language, score) of each text; the score is the share of that language among its telling grams."""
        import numpy as np

        out: list = [(UNDETERMINED, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not self.languages:
            return out
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            theta, n = self.proportions(self.counts([texts[i] for i in part]))
            theta = np.where(n[:, None] > 0, theta, self.prior[None, :])
            for i, share in zip(part, theta):
                j = int(share.argmax())
                out[i] = (self.languages[j], float(min(1.0, max(0.0, share[j]))))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a text and a language that are not held out; an empty model if there are none.

    The sample is by hash, so reruns agree; its n-grams are counted where they are read, as one row a language and
    partition, and added up by language and bucket.
    """
    import numpy as np

    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1_000_000, 1_000_000 * TEXTS_A_LANGUAGE // v))])
    sample = known.filter(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1_000_000)) < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def run(batches):
        total: dict[str, object] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[lang] = total.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    found = map_batches(sample, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: j for j, lang in enumerate(languages)}
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] = found["n"].to_numpy()
    p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=0)
    mean = p.mean(axis=1, keepdims=True)
    telling = np.argsort(-(p * np.abs(np.log(p / mean))).sum(axis=1), kind="stable")[:TELLING]
    index = np.full(BUCKETS, -1, np.int64)
    index[telling] = np.arange(len(telling))
    kept = p[telling]
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, index, kept / kept.sum(axis=0), prior / prior.sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0. A text none of whose n-grams is known gets the
    commonest language with its share as score. Repeated rows are answered alike; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = model.predict([t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else None for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    done = map_batches(source, run, f"id {dict(source.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)
    return done.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
