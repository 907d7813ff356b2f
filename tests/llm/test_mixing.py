from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rosterwise.llm import mixing
from rosterwise.llm.tables import table


def targets(sizes):
    """Shares by weight, the excess over three times the size shared again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, weight = sum(sizes.values()) - sum(fixed.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / weight for s in open_}
        fixed |= {s: 3 * sizes[s] for s in over}


def closed_form():
    """Whole epochs, and what gets through of the last one."""
    size, goal, all_words = F.col("_size"), F.col("_goal"), F.col("_source_size")
    full = F.when(all_words > 0, F.floor(goal / all_words)).otherwise(0).cast("long")
    return full * size + F.greatest(F.lit(0), F.least(size, goal - full * all_words - F.col("_before")))


def check(docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").split())  # the fixtures have no other white space
    want = targets(sizes)
    sizes = mixing.measured(docs)
    got = mixing.queued(sizes, sizes).withColumn("_taken", closed_form()).collect()
    assert len(got) == len(rows)
    # What the sorted queue takes, cut at the budget, is what can be worked out for each source alone.
    mixed = mixing.mixed_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in mixed) == Counter((r.doc_id, r._size, r._taken) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r._taken
        assert 0 <= r._taken <= 3 * r._size and r._target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1
    assert Counter(map(tuple, mixing.mixed_documents(docs).collect())) == Counter(map(tuple, mixing.mixed_documents(docs.repartition(3)).collect()))
    return {(r.doc_id, r.text): r._taken for r in got}


def test_targets_are_met(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))


def test_odd_rows_and_copies(spark, odd_docs, no_docs):
    small = [(i, "w " * (i % 5 + 1), "en", "big" if i < 80 else "tiny", 1) for i in range(84)]
    docs = spark.createDataFrame(small, "doc_id long, text string, lang string, source string, n_chars long")
    taken = check(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({d: t for (d, _), t in taken.items() if t})
    clean = odd_docs.filter("text is null or text not like '% %'")
    assert mixing.mix(clean).columns == odd_docs.columns
    check(clean)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_finish_times_interleave(spark):
    docs = spark.createDataFrame(
        [(i, "a b c d", "en", "abc"[i % 3], 7) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    sent = sorted(mixing.sent(docs).collect(), key=lambda r: (r._finish, r._shuffle))
    # Any stretch of the mix has the sources near their shares.
    share = Counter(r.source for r in sent[:100])
    for source, weight in zip("abc", (5, 2, 1)):
        assert abs(share[source] - 100 * weight / 8) <= 2
