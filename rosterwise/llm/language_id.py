"""Language identification: multinomial naive Bayes over hashed character n-grams.

n-grams of one to three characters of the lower-cased text are hashed into buckets. Counts per
language come from all training rows; the matrix of log-probabilities (buckets x languages) is
broadcast in blocks of languages, of MATRIX numbers at most each. Texts are scored in batches by
gathering the matrix rows of their n-grams and adding them up per text, block after block; the best
language over all blocks counts, and a worker holds one block at a time if there are several.

Cases: a text without a letter, a null text, or nothing to learn from gives ``und`` with score 0; ties
go to the smaller language name; training rows without text or language teach nothing; each row is
predicted by its own text, so repeated rows agree.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import chunks, counted, hashed

#: Bits of the hash, and numbers in a block of the broadcast matrix (8 bytes each) at most.
BITS, MATRIX = 16, 1 << 22
UNKNOWN = "und"


def held_out(doc_id="doc_id"):
    """A quarter of the ids; rows without an id are not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, bits=BITS):
    """Broadcast (languages, matrix, log-priors), one for each block of languages, in order of the names.

    Matrices hold log-probabilities with one added to each count. ``rows``: lang, text. Priors are
    the shares of the training texts.
    """
    known = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    texts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, buckets = sorted(texts), 1 << bits
    prior = np.array([texts[x] for x in names], float)
    prior = np.log(prior / prior.sum())
    width, model = max(1, MATRIX >> bits), []
    for lo in range(0, len(names), width):
        languages = names[lo : lo + width]
        some = known if len(names) <= width else known.filter(F.col("lang").isin(languages))
        counts = counted(some, lambda text: hashed(text.lower(), buckets), buckets).toPandas()
        place = {x: i for i, x in enumerate(languages)}
        matrix = np.ones((buckets, len(languages)))
        matrix[counts["feature"], counts["class"].map(place)] += counts["n"]
        block = languages, np.log(matrix / matrix.sum(0)), prior[lo : lo + width]
        model.append(rows.sparkSession.sparkContext.broadcast(block))
    return model


def scores(texts, matrix, prior):
    """Log-likelihoods (texts x languages)."""
    out = np.tile(prior, (len(texts), 1))
    for held in chunks(texts):
        found = [hashed(t.lower(), len(matrix)) for _, t in held]
        sizes = np.array([len(x) for x in found])
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            sums = np.add.reduceat(matrix[np.concatenate(found)], starts, axis=0)
            out[np.array([i for i, _ in held])[some]] += sums
    return out


def best_of(texts, model):
    """(language, posterior) of each text; ties go to the earlier block, and within it to the first name."""
    best, top, odds = np.full(len(texts), UNKNOWN, object), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for shared in model:
        languages, matrix, prior = shared.value
        logs = scores(texts, matrix, prior)
        if len(model) > 1:
            del matrix
            vars(shared).pop("_value", None)  # read again from its file for the next batch
        high = logs.max(1)
        best = np.where(high > top, np.array(languages, object)[logs.argmax(1)], best)
        both = np.maximum(top, high)
        odds = odds * np.exp(top - both) + np.exp(logs - high[:, None]).sum(1) * np.exp(high - both)
        top = both
    return best, 1 / odds


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of lang_pred) of every row."""

    @F.pandas_udf("lang string, score double")
    def guess(text: pd.Series) -> pd.DataFrame:
        lang, score = best_of(text.tolist(), model)
        return pd.DataFrame({"lang": lang, "score": score})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    readable = F.col("text").rlike(r"\p{L}")
    if not model:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.select("doc_id", readable.alias("ok"), guess("text").alias("g"))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.when(F.col("ok"), F.col("g.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("ok"), F.col("g.score")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out, predicts all."""
    return predict(docs, train(docs.filter(~held_out()).select("lang", "text")))
