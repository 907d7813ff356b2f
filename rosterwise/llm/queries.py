"""One query per operator of this folder, over its whole table."""

import uuid

import public_tokenizers

from rosterwise.session import shared_folder

from . import (
    bpe, fingerprints, hard_negatives, language_id, mixing, near_dedup, pii, preferences, prefix_trie, quality, secret_scan,
    token_files, topk_search,
)
from .tables import table

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark, sf_dir):
    return preferences.preference_documents(table(spark, sf_dir, "conversations"))


def op3_maxscore_search(spark, sf_dir):
    return topk_search.nearest(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    return near_dedup.document_components(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_token_files(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    return token_files.token_index(spark, folder)


def op9_quality_resampling(spark, sf_dir):
    rows = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "log_weight", "noisy_weight", "rank")


def op10_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


_QUERIES = [
    op1_document_fingerprints, op2_preference_pairs, op3_maxscore_search, op4_language_id, op5_simhash_near_dedup,
    op6_source_mixing, op7_byte_bpe, op8_token_files, op9_quality_resampling, op10_personal_data,
    op11_secret_scan, op12_hard_negatives, op13_prefix_trie,
]


def queries():
    return {q.__name__: q for q in _QUERIES}
