"""Document fingerprints: SimHash of weighted terms, and search by permuted block tables.

DataFrame functions only. Terms are runs of three words; a term counts once for each occurrence and
for each of its characters, so long, rare wordings outweigh short, common ones. Its 64-bit hash votes
for a bit if it is set, against it if not; the fingerprint has the bits that won. One aggregation,
combined map-side, does it for any length of text: a hot text is one row of sums.

Cases: a null text is an empty one; an empty text has fingerprint 0; equal texts have equal
fingerprints; repeated rows (same key, same text) give as many equal rows; columns that are not
named are left out, so names can't clash.
"""

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .tables import all_votes, explode_shingles, hex16, with_next

#: Words of a term.
TERM_WORDS = 3
#: Blocks of the fingerprint in the tables; radius of the search.
BLOCKS, RADIUS = 5, 3


def fingerprints(rows: DataFrame, keys: list[str], text="text", words=TERM_WORDS) -> DataFrame:
    """``keys`` and ``fingerprint`` (long) for each row.

    ``keys`` must tell texts apart: rows equal in all of them must have equal texts.
    """
    texts = rows.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
    terms = explode_shingles(texts, F.col("_text"), words).select(
        *keys, F.xxhash64("term").alias("_bits"), F.char_length("term").cast("long").alias("_weight"), "at"
    )
    # Rows with equal keys vote together, which changes no share; their first terms count them.
    summed = all_votes(terms, keys, "_bits", "_weight", [F.sum((F.col("at") == 0).cast("long")).alias("_rows")])
    return summed.select(*keys, "fingerprint", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_i")).drop("_i")


def block_masks(blocks=BLOCKS, radius=RADIUS) -> list[int]:
    """One mask per table: the bits of the ``blocks - radius`` blocks that lead in it.

    ``radius`` differing bits touch as many blocks at most, so in some table all leading blocks agree.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    masks = [sum(parts[i] for i in lead) for lead in itertools.combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_tables(codes: DataFrame, code: str, masks: list[int]) -> DataFrame:
    """``codes`` once for each table, with the ``_table`` and its ``_key``, the leading blocks."""
    rows = codes.withColumn("_entry", F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col(code).bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for i, m in enumerate(masks)
    ])))
    return rows.select(*codes.columns, F.col("_entry.table").alias("_table"), F.col("_entry.key").alias("_key"))


def near_fingerprints(queries: DataFrame, codes: DataFrame, blocks=BLOCKS, radius=RADIUS) -> DataFrame:
    """(query, code, distance) of all codes within ``radius`` bits, each pair once.

    ``queries`` has distinct ``query``, ``codes`` distinct ``code`` (longs, and more columns), so
    copies of a text are one entry. A pair is emitted by the first of the tables in which it agrees.
    """
    masks = block_masks(blocks, radius)
    differ = F.col("query").bitwiseXOR(F.col("code"))
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)).otherwise(first)
    left = block_tables(queries, "query", masks).alias("q")
    right = block_tables(codes, "code", masks).alias("c")
    same = (F.col("q._table") == F.col("c._table")) & (F.col("q._key") == F.col("c._key"))
    near = (F.bit_count(differ) <= radius) & (first == F.col("q._table"))
    others = [c for c in codes.columns if c != "code"]
    return left.join(right, same & near).select("query", "code", *others, F.bit_count(differ).alias("distance"))


def likeness(a, b):
    """Share of equal bits."""
    return (64 - F.bit_count(F.col(a).bitwiseXOR(F.col(b)))) / F.lit(64.0)


def edited_texts(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last third replaced by the head of the next document.

    text_hash and next_hash, with doc_id and next_id, tell rows with equal ids apart.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    third = "cast(char_length(text) div 3 as int)"
    return with_next(rows, "doc_id", "text").select(
        "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_hash"),
        F.expr(f"concat(left(text, char_length(text) - {third}), left(next.text, {third}))").alias("edited"),
        F.col("next.doc_id").alias("next_id"), F.xxhash64("next.text").alias("next_hash"),
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and what lies near.

    n_near counts the other documents within RADIUS bits, for documents whose id is divisible by 50
    (null for the others): those are the queries of the search against all rows.
    """
    rows = edited_texts(docs).withColumn("edited_sha", F.unhex(F.sha2("edited", 256)))
    keys = ["doc_id", "n_chars", "text_hash", "edited_sha", "next_id", "next_hash"]
    both = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("body")),
        F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("body")),
    )).alias("_b")).select(*keys, "_b.is_edit", "_b.body")
    paired = fingerprints(both, [*keys, "is_edit"], "body").groupBy(*keys).agg(
        F.max(F.when(~F.col("is_edit"), F.col("fingerprint"))).alias("fp"),
        F.max(F.when(F.col("is_edit"), F.col("fingerprint"))).alias("edited_fp"),
        F.sum(F.col("is_edit").cast("long")).alias("copies"),
    )
    kept = cut_lineage(paired)
    others = kept.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("fp").alias("next_fp")
    ).distinct()
    result = kept.join(others, F.col("next_id").eqNullSafe(F.col("_id")) & (F.col("next_hash") == F.col("_hash")), "left")
    codes = kept.groupBy(F.col("fp").alias("code")).agg(F.sum("copies").alias("docs"))
    asked = kept.filter("doc_id % 50 = 0").select(F.col("fp").alias("query")).distinct()
    found = near_fingerprints(asked, codes).groupBy("query").agg(F.sum("docs").alias("near_docs"))
    return result.join(found, F.col("fp") == F.col("query"), "left").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("near_docs") - 1).alias("n_near"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_i"),
    ).drop("_i")
