"""Token-id files: every document is a zstandard frame of its own, under one shared dictionary.

Files are Parquet tables that Spark writes, so any store that Spark reaches will do and a lost task
leaves nothing behind. ``dictionary`` has one row (dict_hash, content). ``blocks`` has, in ascending
doc_id order, rows of up to BLOCK_BYTES: shard, block, dict_hash, the doc_ids, the tokens of each,
``offsets`` (where each frame starts in ``frames``, and its end) and ``frames``. A document is read
by its frame alone: Parquet's statistics and the offsets lead to it.

The dictionary is trained on the serialised ids of SAMPLE runs of SAMPLE_CHARS characters at most, from
hashed places of whole documents; it only changes sizes, never ids. Each document ends with END_ID.

Cases: a null text is an empty one and has the end id alone; rows with equal ids go by text; null ids
come first; strings of added tokens are those tokens, as in the library; an empty table gives empty files; other columns are left out.
"""

import functools
import hashlib
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import encode_pieces, ragged

END_ID = 0
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 64 * 1024
BLOCK_BYTES, LEVEL = 1 << 20, 3
#: Ids as stored: 16 bits hold a vocabulary of up to 65,536.
STORED = "<u2"
BLOCKS = (
    "shard int, block int, first_id long, dict_hash string, doc_ids array<long>, tokens array<long>, "
    "offsets array<long>, frames binary"
)
#: Pre-tokens that a worker keeps (the half used last stays when there are more), and the longest one, in bytes.
KEPT, KEPT_BYTES = 600_000, 48


class LibraryEncoder:
    """Ids by the tokenizers library; each distinct pre-token goes through it once while it is kept.

    The file's pre-tokenizer splits by the pattern that ``pretokens`` splits by, and its model works
    on each pre-token alone. A text that holds the string of an added token, which the library looks for
    before all else, goes through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already take every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > np.iinfo(STORED).max + 1:
            raise ValueError("the vocabulary doesn't fit the stored ids")
        # The number of each kept pre-token, its ids, and the round that used it last.
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.round = 0

    def ids_of(self, words: pa.LargeBinaryArray):
        """All ids of ``words``, and how many each has; the library encodes those that aren't kept from before."""
        keys = words.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(codes < 0)
        new = words.take(pa.array(unknown)).cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter(itertools.chain.from_iterable(found), np.uint32, n.sum())
        codes[unknown] = len(self.sizes) + np.arange(len(new))
        flat, sizes = np.concatenate([self.flat, more]), np.concatenate([self.sizes, n])
        starts = np.cumsum(sizes) - sizes
        out = flat[ragged(codes, starts, sizes)[0]], sizes[codes]
        self._keep(keys, codes, unknown, flat, sizes, starts)
        return out

    def _keep(self, keys, codes, unknown, flat, sizes, starts):
        """Keeps the new words that aren't too long; beyond KEPT, the half of all words that was used last."""
        self.round += 1
        before = len(self.sizes)
        self.used[codes[codes < before]] = self.round
        short = [i for i in unknown.tolist() if len(keys[i]) <= KEPT_BYTES]
        self.known.update(zip((keys[i] for i in short), itertools.count(before)))
        at = codes[short]
        self.flat = np.concatenate([self.flat, flat[ragged(at, starts, sizes)[0]]])
        self.sizes, self.used = np.append(self.sizes, sizes[at]), np.append(self.used, np.full(len(at), self.round))
        if len(self.sizes) > KEPT:
            last = np.sort(np.argsort(-self.used, kind="stable")[: KEPT // 2])
            names = list(self.known)  # in the order of their numbers
            self.known = dict(zip((names[i] for i in last.tolist()), itertools.count()))
            self.flat = self.flat[ragged(last, np.cumsum(self.sizes) - self.sizes, self.sizes)[0]]
            self.sizes, self.used = self.sizes[last], self.used[last]

    def encode(self, texts):
        whole = {}

        def plain():
            for i, text in enumerate(texts):
                if any(token in text for token in self.added):
                    whole[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
                    text = ""
                yield text

        for i, ids in enumerate(encode_pieces(plain(), self.ids_of)):
            yield np.append(np.array(whole.pop(i), np.uint32) if i in whole else ids, np.uint32(END_ID))


@functools.lru_cache(maxsize=1)
def _encoder(path):
    return LibraryEncoder(path)


def _dictionary(content: bytes):
    return zstandard.ZstdCompressionDict(content)


def drawn_blocks(docs: DataFrame) -> list[str]:
    """SAMPLE of the runs of SAMPLE_CHARS characters that whole documents consist of: those of lowest hash."""
    text = F.coalesce("text", F.lit(""))
    runs = F.greatest(F.lit(1), F.ceil(F.char_length(text) / SAMPLE_CHARS)).cast("int")
    n = docs.agg(F.sum(runs)).first()[0] or 1
    mark = lambda h, i: F.xxhash64(h, i).cast("double") / F.lit(2.0**64) + 0.5
    rows = docs.select(text.alias("text"), F.xxhash64("doc_id", "text").alias("h"), runs.alias("runs"))
    low = F.filter(F.sequence(F.lit(0), F.col("runs") - 1), lambda i: mark(F.col("h"), i) <= 2.0 * SAMPLE / n)
    drawn = rows.withColumn("i", F.explode(low)).select(
        F.substring("text", F.col("i") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("block"), mark(F.col("h"), F.col("i")).alias("m")
    )
    return [r.block for r in drawn.orderBy("m").limit(SAMPLE).collect()]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """Trained on a bounded sample (``drawn_blocks``); raw content where that is too small."""
    samples = [ids.astype(STORED).tobytes() for ids in _encoder(path).encode(drawn_blocks(docs))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def _pack(path, content):
    mark = hashlib.sha256(content.value).hexdigest()

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content.value))
        encoder, shard, block = _encoder(path), TaskContext.get().partitionId(), 0
        ids_of, tokens, frames, size = [], [], [], 0

        def flush():
            nonlocal block, ids_of, tokens, frames, size
            offsets = [0, *itertools.accumulate(map(len, frames))]
            row = [shard, block, ids_of[0], mark, ids_of, tokens, offsets, b"".join(frames)]
            kinds = [
                pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                pa.list_(pa.int64()), pa.binary(),
            ]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            block, ids_of, tokens, frames, size = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), encoder.encode(t.as_py() or "" for t in batch.column(1)))
            for doc_id, ids in rows:
                frames.append(compressor.compress(ids.astype(STORED).tobytes()))
                ids_of.append(doc_id)
                tokens.append(len(ids))
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield flush()
        if frames:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, folder: str) -> None:
    """Writes ``docs`` (doc_id, text) encoded by the tokenizer file ``path`` to ``folder``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    content = train_dictionary(rows, path)
    spark.createDataFrame(
        [(hashlib.sha256(content).hexdigest(), bytearray(content))], "dict_hash string, content binary"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")
    order = ["doc_id", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Heads of texts cut the ranges in the order that whole texts have within them.
    dealt = rows.repartitionByRange(parts, "doc_id", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(_pack(path, spark.sparkContext.broadcast(content)), BLOCKS)
    blocks.write.parquet(f"{folder}/blocks")


def _unpacked(table, content, mark):
    """(doc_id, ids) of each document of the blocks, in order."""
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    for block in table.to_pylist():
        if block["dict_hash"] != mark:
            raise ValueError("the block was written with another dictionary")
        frames = memoryview(block["frames"])
        for doc_id, n, lo, hi in zip(block["doc_ids"], block["tokens"], block["offsets"], block["offsets"][1:]):
            ids = np.frombuffer(reader.decompress(frames[lo:hi], max_output_size=n * np.dtype(STORED).itemsize), STORED)
            if len(ids) != n:
                raise ValueError(f"document {doc_id}: {len(ids)} ids instead of {n}")
            yield block, doc_id, ids


def _content(spark, folder):
    mark, content = spark.read.parquet(f"{folder}/dictionary").first()
    return bytes(content), mark


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """shard, block, place, doc_id, n_tokens, before (ids before it in its block), ids_crc32."""
    content, mark = _content(spark, folder)
    names = ["shard", "block", "place", "doc_id", "n_tokens", "before", "ids_crc32"]

    def run(batches):
        for batch in batches:
            rows, at, place, before = [], None, 0, 0
            for block, doc_id, ids in _unpacked(batch, content, mark):
                if at is not block:
                    at, place, before = block, 0, 0
                rows.append((block["shard"], block["block"], place, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                place, before = place + 1, before + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n in names[:3] else pa.int64()) for n, c in zip(names, zip(*rows))], names
                )

    schema = "shard int, block int, place int, doc_id long, n_tokens long, before long, ids_crc32 long"
    return spark.read.parquet(f"{folder}/blocks").drop("first_id").mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """Ids of one document, from its frame alone."""
    content, mark = _content(spark, folder)
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    row = (
        spark.read.parquet(f"{folder}/blocks").filter((F.col("first_id") <= doc_id) & (at > 0))
        .select("dict_hash", F.element_at("tokens", at).alias("n"), F.expr(
            f"substring(frames, cast(offsets[array_position(doc_ids, {int(doc_id)}L) - 1] as int) + 1, "
            f"cast(offsets[array_position(doc_ids, {int(doc_id)}L)] - offsets[array_position(doc_ids, {int(doc_id)}L) - 1] as int))"
        ).alias("frame")).first()
    )
    if row is None:
        raise KeyError(doc_id)
    frame = bytes(row.frame)
    block = {"dict_hash": row.dict_hash, "doc_ids": [doc_id], "tokens": [row.n], "offsets": [0, len(frame)], "frames": frame}
    return next(_unpacked(pa.Table.from_pylist([block]), content, mark))[2].tolist()


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    rows = read_token_files(spark, folder)
    index = spark.read.parquet(f"{folder}/blocks").select(
        "shard", "block", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("tokens")
    )

    def before(window):
        return F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # One window over whole shards, of which there are as many as tasks wrote; one within each shard.
    shards = index.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("_shard"))
    blocks = index.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("_block"))
    starts = blocks.join(shards, "shard").select("shard", "block", (F.col("_shard") + F.col("_block")).alias("_start"))
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
