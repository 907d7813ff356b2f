import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from rosterwise.llm import bpe, mixing, near_dedup, pii, quality
from rosterwise.llm.queries import RANKS, queries
from rosterwise.llm.tables import table


def test_stages_follow_one_another(spark, sf_dir):
    """run() against the stages' own effects, each on what the one before kept."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    good = quality.keep(documents, labels).cache()
    single = near_dedup.keep_one(good).cache()
    ids = {r.component_id for r in near_dedup.document_components(good).collect()}
    assert {r.doc_id for r in single.collect()} == ids and single.count() < good.count() < documents.count()
    masked = pii.redact(single).cache()
    mixed = mixing.mix(masked).collect()
    for stage in (good, single, masked):
        assert stage.columns == documents.columns
    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = bpe.read_ranks(lines)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want


def test_columns_of_any_name_come_through(spark):
    """Every stage keeps what columns hold whose names the operators use themselves, and decides as without them."""
    names = ["_id", "_hash", "_text_hash", "_size", "_words", "_text", "_spans", "row", "root", "rank", "log_weight"]
    texts = [f"the house number {i} was red and mail a{i}@b.cd went out to 10.0.0.{i}" for i in range(25)]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate([*texts, texts[3], "zz zz zz", None])]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, plain)
    more = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], plain + "".join(f", {n} string" for n in names))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(25)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: quality.keep(d, labels), near_dedup.keep_one, pii.redact, mixing.mix):
        got, want = stage(more), stage(docs)
        assert got.columns == more.columns
        found = [tuple(r) for r in got.collect()]
        assert Counter(r[:5] for r in found) == Counter(map(tuple, want.collect()))
        assert all(r[5:] == tuple(f"{n}{r[0]}" for n in names) for r in found)


def test_every_operator_is_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries()) <= set(names) and "pipeline" in names
    assert set(driver.oracle_sql()) <= set(names)
