"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprints take one vote per three-word shingle. Two that differ in 3 bits or fewer share at least
5 of their 8 positional bytes. Lists of single bytes would pair a 256th of everything, so the index
is keyed by three positions at once: of 5 shared positions, 3 lie in the same half, hence every such
pair meets in one of the 4 + 4 lists of its halves' triples. Within a list the shared positional
bytes of each pair are tallied, pairs under the guaranteed minimum go, the rest is verified bit by
bit. A list yields a spanning forest of its links, never all pairs, and long lists are dealt out
in pairs of blocks. Components of the links come from ``components``.

Cases: a null text is an empty one, which has no words: fingerprint 0, linked like any other. Texts
of one or two words have one shingle. Repeated rows are equal documents. A null doc_id stays in the
result and counts for component_id only if its whole component has none (null then).
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .components import components
from .tables import LOWER, UPPER, all_votes, explode_shingles, hex16, packed, unpacked

SHINGLE_WORDS, MAX_BITS = 3, 3
POSITIONS = 8
#: Fingerprints of a list that are compared at once.
BLOCK = 1024


def simhashes(docs: DataFrame, words=SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint and text_hash of every row."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text.alias("_text"))
    shingles = explode_shingles(rows, F.col("_text"), words).select(
        "doc_id", "text_hash", F.xxhash64("term").alias("_bits"), (F.col("term") != "").cast("long").alias("_one"), "at"
    )
    # Equal rows vote together; the vote is by shares, so it stays the same.
    summed = all_votes(shingles, ["doc_id", "text_hash"], "_bits", "_one", [F.sum((F.col("at") == 0).cast("long")).alias("_n")])
    return summed.select(
        "doc_id", "text_hash", "fingerprint", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")
    ).drop("_i")


def position_sets(max_bits=MAX_BITS) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any two near fingerprints share."""
    if not 0 <= max_bits <= 3:
        raise ValueError("position sets are laid out for up to 3 bits")
    halves = range(POSITIONS // 2), range(POSITIONS // 2, POSITIONS)
    return [s for half in halves for s in itertools.combinations(half, 3)]


def _postings(codes):
    entries = []
    for i, positions in enumerate(position_sets()):
        mask = sum(0xFF << 8 * p for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        entries.append(F.struct(F.lit(i).alias("list"), F.col("code").bitwiseAND(F.lit(signed).cast("long")).alias("bytes")))
    rows = codes.select("code", F.explode(F.array(*entries)).alias("e"))
    return rows.select("code", F.col("e.list").alias("list"), F.col("e.bytes").alias("bytes"))


def _forest(codes, parts, max_bits):
    """Links that span each component of near codes; across parts only, if there are two."""
    n = len(codes)
    across = parts.min() != parts.max()
    left = np.arange(n)
    out, todo = [], np.ones(n, bool)
    while todo.any():
        seed = left[todo][0]
        todo[seed] = False
        front = np.array([seed])
        while len(front):
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            differ = codes[front][:, None] ^ codes[rest][None, :]
            shared = (differ.view(np.uint8).reshape(*differ.shape, POSITIONS) == 0).sum(-1)
            near = (shared >= POSITIONS - max_bits) & (np.bitwise_count(differ) <= max_bits)
            if across:
                near &= parts[front][:, None] != parts[rest][None, :]
            hit = near.any(0)
            front = rest[hit]
            out += zip(itertools.repeat(codes[seed]), codes[front])
            todo[front] = False
    return out


def _links(max_bits):
    names = ["list", "bytes", "i", "j"]

    def emit(table):
        cols = [table.column(x).to_numpy() for x in names]
        codes = table.column("code").to_numpy().view(np.uint64)
        parts = table.column("part").to_numpy()
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0) if len(codes) > 1 else np.zeros(0, bool)
        edges = np.flatnonzero(np.r_[True, new, True])
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        differ = codes[two] ^ codes[two + 1]
        shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(-1)
        near = (shared >= POSITIONS - max_bits) & (np.bitwise_count(differ) <= max_bits)
        pairs = [(codes[two][near], codes[two + 1][near])]
        for lo, hi in zip(edges[:-1][size > 2], edges[1:][size > 2]):
            found = _forest(codes[lo:hi], parts[lo:hi], max_bits)
            if found:
                pairs.append(tuple(np.array(x, np.uint64) for x in zip(*found)))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held else table
            last = [held.column(x)[-1].as_py() for x in names]
            same = np.all([held.column(x).to_numpy() == v for x, v in zip(names, last)], axis=0)
            # The last list may go on in the next batch; a block pair bounds its length.
            cut = int(np.argmax(same))
            if cut:
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held and held.num_rows:
            yield emit(held)

    return run


def near_links(codes: DataFrame, max_bits=MAX_BITS) -> DataFrame:
    """Links (a, b) that connect what near pairs of the distinct ``code`` (long) connect."""
    postings = _postings(codes)
    sizes = postings.groupBy("list", "bytes").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    met = postings.join(sizes, ["list", "bytes"]).withColumn("_blocks", blocks).withColumn(
        "part", F.pmod(F.xxhash64("code"), F.col("_blocks")).cast("int")
    )
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")).select(
        "list", "bytes", F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "code"
    )
    keys = ["list", "bytes", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, words=SHINGLE_WORDS, max_bits=MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), component_id of every row, and its component's first row.

    ``is_first`` marks the distinct (doc_id, text_hash) that stands for the component: the smallest.
    """
    coded = simhashes(docs, words)
    codes = coded.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least"))
    links = near_links(codes.select("code"), max_bits)
    roots = cut_lineage(components(links))
    placed = codes.join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "least", F.coalesce("root", "code").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(firsts, "root").select("code", "root", "component_id")
    return coded.join(named, F.col("fingerprint") == F.col("code")).select(
        "doc_id", "text_hash", "fingerprint", "component_id", "root"
    )


def keep_one(docs: DataFrame, words=SHINGLE_WORDS, max_bits=MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then hash."""
    found = near_duplicates(docs, words, max_bits)
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = found.groupBy("root").agg(F.min(first).alias("f")).select(
        F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash")
    )
    names = ["doc_id", "text"]
    hashed = packed(docs, names).withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    # Equal rows (id and text) are one document.
    return unpacked(rows.dropDuplicates(["doc_id", "_text_hash"]), docs, names)


def document_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex16("fingerprint").alias("fingerprint"), "component_id")
