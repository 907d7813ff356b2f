"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Each adjacent pair that has a merge rank puts the place of
its left span into the bucket of that rank; bitmaps of two levels (256-way) tell which buckets are
filled, so find-first-set gives the lowest rank in two steps. A bucket's places are taken from left
to right; an entry whose pair has changed since is stale and skipped. A merge is a constant number of
steps and the queue never sorts or scans, so a pre-token of millions of bytes takes time in proportion
to its length. Ids of short pre-tokens are kept, up to a bound.

Cases: a null text is an empty one and has no ids; repeated rows are encoded each; equal ranks within
a pre-token merge from the left; other columns are left out.
"""

import base64
import functools
import hashlib
import itertools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import encode_texts, ragged

#: Pre-tokens in each of the two generations that a worker keeps, and the longest one, in bytes.
KEPT, KEPT_BYTES = 300_000, 48
#: Ranks under one word of the lower bitmap.
WIDTH = 256
_BIT = [1 << i for i in range(WIDTH)]


def read_ranks(lines) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * (max(ranks.values()) // WIDTH + 1)
        self.two = [ranks.get(bytes(divmod(i, 256)), -1) for i in range(1 << 16)]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merged(self, word: bytes) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers.

        The queue is ``buckets`` by rank, ``low``, a bit per filled bucket, and ``top``, a bit per
        word of ``low`` that isn't 0. It is empty before and after.
        """
        ranks, two, low, n = self.ranks, self.two, self.low, len(word)
        if word in ranks:
            return ranks[word].to_bytes(4, "little")
        get = ranks.get
        # Span i is word[i:end[i]]; back[end] leads to the span that ends there.
        end, back = list(range(1, n + 1)), list(range(-1, n))
        pair, buckets, top = [], {}, 0
        for i in range(n - 1):
            rank = two[word[i] << 8 | word[i + 1]]
            pair.append(rank)
            if rank in buckets:
                buckets[rank].append(i)
            elif rank >= 0:
                buckets[rank] = [i]
                low[rank >> 8] |= _BIT[rank & 255]
                top |= 1 << (rank >> 8)
        pair.append(-1)
        while top:
            high = (top & -top).bit_length() - 1
            bits = low[high]
            first = bits & -bits
            bits ^= first
            low[high] = bits
            if not bits:
                top &= top - 1
            rank = high << 8 | first.bit_length() - 1
            # A merge here makes longer pieces only, so none of this rank is added meanwhile.
            places, lower = buckets.pop(rank), False
            if len(places) > 1:
                places.sort()
            for k, i in enumerate(places, 1):
                if pair[i] != rank:
                    continue  # stale
                j = end[i]  # the span that is merged into i
                pair[j] = -1
                stop = end[i] = end[j]
                back[stop] = i
                before = back[i]
                pair[i] = new = get(word[i : end[stop]], -1) if stop < n else -1
                if new in buckets:
                    buckets[new].append(i)
                elif new >= 0:
                    buckets[new] = [i]
                    low[new >> 8] |= _BIT[new & 255]
                    top |= 1 << (new >> 8)
                    lower = new < rank
                if before >= 0:
                    pair[before] = new = get(word[before:stop], -1)
                    if new in buckets:
                        buckets[new].append(before)
                    elif new >= 0:
                        buckets[new] = [before]
                        low[new >> 8] |= _BIT[new & 255]
                        top |= 1 << (new >> 8)
                        lower = lower or new < rank
                if lower and k < len(places):
                    # A pair of lower rank has come up: that one is next, the rest waits.
                    buckets[rank] = places[k:]
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= 1 << (rank >> 8)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        young, old, out = self.young, self.old, []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = old.get(word) or self.merged(word)
                if len(word) <= KEPT_BYTES:
                    if len(young) >= KEPT:
                        self.old, self.young = old, young = young, {}
                    young[word] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]):
        return encode_texts(texts, self.encode_words)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for piece, i in ranks.items():
            by_id[i] = piece
        self.sizes = np.fromiter(map(len, by_id), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        at, _ = ragged(ids.astype(np.int64), self.starts, self.sizes)
        return self.flat[at].tobytes()


def load_ranks(spark: SparkSession, path: str):
    """The rank file, read by the driver and broadcast: its size is that of a vocabulary (under 1 MB)."""
    with open(path, "rb") as lines:
        return spark.sparkContext.broadcast(read_ranks(lines))


@functools.lru_cache(maxsize=2)
def _coders(key, holder):
    ranks = holder.value
    return Encoder(ranks), Decoder(ranks)


class _Held:
    """Makes a broadcast usable as a cache argument: one vocabulary per key in a worker."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __eq__(self, other):
        return True

    def __hash__(self):
        return 0


def _batches(batches, size=4_000_000):
    """Slices of ``batches`` whose texts (second column) have about ``size`` bytes."""
    for batch in batches:
        texts = batch.column(1)
        lengths = np.asarray(pc.binary_length(texts).fill_null(0))
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
        for lo, hi in itertools.pairwise([0, *cuts, len(lengths)]):
            yield batch.slice(lo, hi - lo)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text."""
    return _mapped(docs, path, "doc_id long, ids array<int>", lambda ids, decoder: [ids.astype(np.int32)])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the digest of the bytes that the ids stand for."""

    def digest(ids, decoder):
        return [
            len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoder.decode(ids)).hexdigest(),
        ]

    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs, path, schema, row):
    from pyspark.sql.pandas.types import to_arrow_schema

    ranks = load_ranks(docs.sparkSession, path)
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        encoder, decoder = _coders(path, _Held(ranks))
        for batch in _batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [row(ids, decoder) for ids in encoder.encode(texts)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], schema=arrow)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
