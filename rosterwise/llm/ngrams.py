"""Hashed character n-grams in arrays, and their counts over a corpus."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-grams of up to so many characters; code points of texts that are worked on together.
LONGEST, CHUNK = 3, 500_000
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def hashed(text: str, buckets: int) -> np.ndarray:
    """The bucket of each n-gram of 1 to LONGEST code points. ``buckets`` is a power of two."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(min(LONGEST, len(points))):
        h = (h[: len(points) - n] * np.uint32(31) + points[n:] + np.uint32(1)) * _ODD[n]
        out.append((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def chunks(texts):
    """Runs of (place, text) with about CHUNK characters."""
    held, size = [], 0
    for item in enumerate(texts):
        held.append(item)
        size += len(item[1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(rows: DataFrame, features, n_features: int) -> DataFrame:
    """(class, feature, n) over ``rows`` (class string, text string), summed over all rows.

    ``features(text)`` gives feature numbers, repeats included. A task adds up its part in one array
    per class, so what it shuffles is bounded by classes x features, whatever its input.
    """

    def run(batches):
        sums = {}
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.bincount(features(text.as_py() or ""), minlength=n_features)
                if kind in sums:
                    sums[kind] += found
                else:
                    sums[kind] = found.astype(np.int64)
        for kind, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                ["class", "feature", "n"],
            )

    return rows.mapInArrow(run, "class string, feature int, n long").groupBy("class", "feature").agg(F.sum("n").alias("n"))
