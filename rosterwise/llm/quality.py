"""Quality classifier by importance resampling.

Two generative models over hashed n-grams: of the target (texts labelled good) and of the raw corpus
(all texts). A document's log importance weight is the sum over its n-grams of the log ratio of the
two, scaled so that a text counts as LENGTH characters at most: long texts of a language that the
labels have a little less of would otherwise fall far below short junk. Documents are resampled without replacement by Gumbel top-k: the k largest log weights plus
Gumbel noise. The noise is a hash of the row, so reruns agree. n-grams are characters (1 to 3) and,
as one more pair, whether neighbouring words are the same or not.

k is the number of documents whose weight reaches the cut, which is where labelled good and bad texts
part best when a lost good text counts as much as CLEAN kept bad ones. The target model comes from one
half, the cut from the other half of at most FIT labelled rows, those of lowest hash; the raw model and
k come from all documents.

Cases: a null or empty text has weight 0; labels that contradict each other or are null teach nothing;
without good labels all weights are 0 and every document stays; ties of the noisy weight go to the
smaller doc_id (null first), then hash; equal rows stand or fall together in ``keep``.
"""

import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .ngrams import counted, hashed
from .tables import packed, ranked, unpacked

BUCKETS = 1 << 16
#: Labelled rows that are fitted on at most; weight of the good ones' share against the bad ones'.
FIT, CLEAN = 20_000, 4.0
#: Characters that a text counts as at most.
LENGTH = 100
SEED = 20240917


def features(text: str) -> np.ndarray:
    """Buckets of characters, then BUCKETS for each pair of equal words, BUCKETS + 1 for other pairs."""
    words = text.split()
    same = sum(map(operator.eq, words, words[1:]))
    pairs = np.repeat(np.array([BUCKETS, BUCKETS + 1], np.uint32), [same, max(len(words) - 1, 0) - same])
    return np.concatenate([hashed(text, BUCKETS), pairs])


def weight_of(text: str, ratio: np.ndarray) -> float:
    """Log importance weight under the log ``ratio`` of each feature."""
    return float(ratio[features(text)].sum() * LENGTH / (LENGTH + len(text)))


def _log_shares(counts):
    """Add-one log-probabilities, of characters and of word pairs apart."""
    smoothed = counts + 1.0
    return np.concatenate([np.log(p / p.sum()) for p in (smoothed[:BUCKETS], smoothed[BUCKETS:])])


def text_hash(text="text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fit_rows(docs: DataFrame, labels: DataFrame, limit=FIT) -> DataFrame:
    """doc_id, ``good`` and ``fits`` (for the model, else for the cut) of a bounded sample of the labels."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)) == 0
    rows = agreed.select("doc_id", (F.col("lo") == 1).alias("good"), half.alias("fits")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit=FIT):
    """(log ratios of the features, cut)."""
    chosen = cut_lineage(fit_rows(docs, labels, limit))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id", "left"  # ``limit`` rows of an id and a flag at most
    )
    # Every text counts for the raw model, the good ones for the target as well.
    kinds = F.when(F.col("good") & F.col("fits"), F.array(F.lit("raw"), F.lit("target"))).otherwise(F.array(F.lit("raw")))
    rows = known.select(F.array_join(kinds, "+").alias("class"), "text")
    counts = counted(rows, features, BUCKETS + 2).toPandas()
    raw, target = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
    np.add.at(raw, counts["feature"], counts["n"])
    good = counts[counts["class"] == "raw+target"]
    if not len(good):
        return np.zeros(BUCKETS + 2), -np.inf
    np.add.at(target, good["feature"], good["n"])
    ratio = _log_shares(target) - _log_shares(raw)
    known = weigh(known.filter("good IS NOT NULL"), ratio, ["good", "fits"]).limit(limit).toPandas()
    others = known[~known["fits"].astype(bool)]
    known = others if others["good"].any() else known
    return ratio, best_cut(known["log_weight"].to_numpy(), known["good"].to_numpy(bool))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on texts stay; without bad texts the lowest good one."""
    order = np.argsort(-weights, kind="stable")
    weights, good = weights[order], good[order]
    gain = CLEAN * np.cumsum(good) / max(good.sum(), 1) - np.cumsum(~good) / max((~good).sum(), 1)
    # Equal weights stay or go together.
    last = np.r_[weights[1:] != weights[:-1], True]
    return float(weights[last][gain[last].argmax()])


def weigh(docs: DataFrame, ratio: np.ndarray, more=()) -> DataFrame:
    """doc_id, text_hash, ``more`` columns and log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weight(text: pd.Series) -> pd.Series:
        values = shared.value
        return pd.Series([weight_of(t, values) for t in text], dtype="float64")

    return docs.select("doc_id", text_hash().alias("text_hash"), *more, weight(F.coalesce("text", F.lit(""))).alias("log_weight"))


def gumbel(*columns):
    """Standard Gumbel noise from a hash, the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)))


def resample(docs: DataFrame, labels: DataFrame, limit=FIT) -> DataFrame:
    """doc_id, text_hash, log_weight, noisy_weight and rank of the documents that stay."""
    ratio, cut = fit(docs, labels, limit)
    noisy = F.col("log_weight") + gumbel("doc_id", "text_hash")
    weighed = weigh(docs, ratio).withColumn("noisy_weight", noisy)
    rows = ranked(weighed, [F.col("noisy_weight").desc(), F.col("doc_id").asc(), F.col("text_hash").asc()])
    k = rows.filter(F.col("log_weight") >= F.lit(float(cut))).count()
    return rows.filter(F.col("rank") <= k)


def keep(docs: DataFrame, labels: DataFrame, limit=FIT) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    kept = resample(docs, labels, limit).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    names = ["doc_id", "text"]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_hash"))
    return unpacked(packed(docs, names).join(kept, same, "left_semi"), docs, names)
