"""From documents to token ids: five stages, each an operator of ``rosterwise.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Between
stages the rows are written as Parquet in the shared folder and read again, so a lost executor never
replays more than one stage. All but the last return the columns of ``docs``.
"""

import public_tokenizers

from rosterwise.llm import bpe, mixing, near_dedup, pii, quality
from rosterwise.llm.queries import RANKS
from rosterwise.llm.tables import table
from rosterwise.session import cut_lineage


def quality_stage(spark, docs, sf_dir):
    """Documents that importance resampling keeps, fitted on the labels."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark, docs, sf_dir):
    """The first document of each component of fingerprints at 3 bits or fewer."""
    return near_dedup.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    """Texts with labels in place of personal data."""
    return pii.redact(docs)


def mixing_stage(spark, docs, sf_dir):
    """A row for each copy that the mix takes, in its order; a cut copy has its first words."""
    return mixing.mix(docs)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to, for each row."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The fitted and hashed stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows
