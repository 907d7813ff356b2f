import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterwise.llm import language_id as lang
from rosterwise.llm import quality
from rosterwise.llm.ngrams import hashed
from rosterwise.llm.tables import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def grams(text, buckets):
    """The hash, one n-gram at a time."""
    points, out = [ord(c) for c in text], []
    odd = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    for n in range(1, 4):
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 31 + points[i + k] + 1) * odd[k] & 0xFFFFFFFF
            out.append((h ^ (h >> 15)) & (buckets - 1))
    return out


def test_hashed_grams():
    for text in ("", "a", "é😀", "hello wörld"):
        assert sorted(hashed(text, 1 << 10).tolist()) == sorted(grams(text, 1 << 10))


def test_languages_equal_plain_naive_bayes_and_are_right_on_held_out_rows(documents):
    rows = documents.collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = {}, Counter()
    for r in rows:
        if not out(r.doc_id) and r.lang is not None:
            texts[r.lang] += 1
            counts.setdefault(r.lang, np.ones(1 << 16))
            np.add.at(counts[r.lang], hashed(r.text.lower(), 1 << 16), 1)
    got = {r.doc_id: r for r in lang.identify(documents).collect()}
    right = total = 0
    for r in rows:
        g = got[r.doc_id]
        feats = hashed(r.text.lower(), 1 << 16)
        logs = {k: math.log(texts[k] / sum(texts.values())) + np.log(c / c.sum())[feats].sum() for k, c in counts.items()}
        assert g.held_out == out(r.doc_id) and 0 <= g.score <= 1
        assert g.lang_pred == max(sorted(logs), key=logs.get)
        right, total = right + (g.held_out and g.lang_pred == r.lang), total + g.held_out
    assert right >= 0.97 * total > 0


def test_blocks_of_languages_change_nothing(documents, monkeypatch):
    rows = documents.select("doc_id", "text", F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("lang"))
    whole = {r.doc_id: r for r in lang.identify(rows).collect()}
    monkeypatch.setattr(lang, "MATRIX", 5 << lang.BITS)  # five languages in a block
    assert len(lang.train(rows.select("lang", "text"))) > 1
    cut = {r.doc_id: r for r in lang.identify(rows).collect()}
    assert len(whole) == len(cut) and all(
        cut[i].lang_pred == r.lang_pred and math.isclose(cut[i].score, r.score, rel_tol=1e-9) for i, r in whole.items()
    )


def test_language_cases(odd_docs, no_docs):
    got = lang.identify(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is not None:
            readable = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not readable) and (readable or r.score == 0)
    assert lang.identify(no_docs).count() == 0
    assert {r.lang_pred for r in lang.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_keeps_the_good_and_rejects_the_bad(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have 11 bad texts
    documents, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    rows = quality.resample(documents, labels).collect()
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1))
    assert [r.rank for r in sorted(rows, key=lambda r: -r.noisy_weight)] == sorted(r.rank for r in rows)
    kept = {r.doc_id for r in rows}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([i for i, q in marks.items() if q == x] for x in (1, 0))
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.15 * len(bad)
    assert {r.doc_id for r in quality.keep(documents, labels).collect()} == kept
    # Weights are the plain sums of the models' log ratios.
    ratio, cut = quality.fit(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows[:40]:
        assert r.log_weight == pytest.approx(quality.weight_of(texts[r.doc_id], ratio))
    assert len(rows) == sum(quality.weight_of(t, ratio) >= cut for t in texts.values())


def test_quality_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (7, None), (14, 1), (14, 1), (21, 0), (10**6, 1)], "doc_id long, quality int")
    kept = quality.keep(odd_docs, labels)
    assert kept.columns == odd_docs.columns and 0 < kept.count() <= odd_docs.count()
    assert quality.keep(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.keep(no_docs, labels).count() == 0
    assert quality.best_cut(np.array([1.0, 2.0, 2.0, 3.0]), np.array([True, True, False, True])) == 1.0
    assert quality.best_cut(np.array([-9.0, 1.0, 2.0]), np.array([False, True, True])) == 1.0
