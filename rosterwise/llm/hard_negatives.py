"""Hard negatives from blocks of vectors along a Hilbert curve, found by their zone maps.

Vectors are sorted by label and by their place on a Hilbert curve over the dimensions that vary most, cut
into blocks of BLOCK rows of one label, and kept as Parquet, a row per block with the least and greatest
component of each dimension: its zone map. Interval arithmetic on a zone map bounds the inner product
of an anchor with any row of the block. A search has windows of scores per anchor and wants the best K in
each; a group of anchors reads the blocks whose bounds meet one of its windows, and no others. The
task that reads them raises each window's floor to the K-th best found so far and passes over blocks
that the floor rules out in the meantime.

First an anchor's own block gives a floor for its positives (the best rows of its label), which
bounds the blocks that a search for them reads; then each positive's score sets a window for the negatives.

Blocks meet anchors by (group of anchors, shard of blocks), each pair a task of bounded size: GROUP anchors,
SHARD blocks. A label that holds most rows is many blocks; nothing is broadcast or collected but the
ranges of at most AXES dimensions.

Cases: rows with a null id, label or vector, or with null or non-finite components, take no part; shorter
vectors are filled up with zeros; of rows with one id the smallest (label, vector) counts, so repeated
rows change nothing; ties go to the smaller id; an anchor without positives has no rows; an empty table
gives none; only vec_id, embedding and label are read, so other columns' names can't clash. A
component beyond 31 bits, or scores beyond 63, end the query with an error rather than wrap.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

#: Rows of a block; blocks of a shard; anchors of a group; shards whose zone maps are looked at in one task.
BLOCK, SHARD, GROUP, ZONES = 256, 64, 4096, 64
#: Dimensions of the Hilbert curve, and bits of each: at most 62 together.
AXES, BITS = 8, 7
#: Positives of an anchor; negatives of a positive; least share of the positive's score, as a fraction.
POSITIVES, NEGATIVES, SHARE = 5, 5, (80, 100)
_MOST = 1 << 62


def candidates(embeddings: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """vec_id, label, anchor, vec (array of int: floor(256 x)) of the rows that take part, one per id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("int"))
    rows = embeddings.filter(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    said = F.struct(label.cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), said.alias("said"))
    return rows.groupBy("vec_id").agg(F.min("said").alias("said")).select("vec_id", "said.label", "said.vec", "said.anchor")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points ``cells`` (points x axes, each below 2**bits), by axis transposition."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(axes)):
            inverted = (axes[i] >> b) & 1 == 1
            swapped = np.where(inverted, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(inverted, axes[0] ^ low, axes[0] ^ swapped)
            if i:
                axes[i] = axes[i] ^ swapped
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    keys = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            keys = keys << 1 | ((axis ^ flips) >> b) & 1
    return keys


def _matrix(vectors, width):
    out = np.zeros((len(vectors), width), np.int32)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def spread_axes(rows: DataFrame) -> list:
    """(dimension, low, high) of the AXES dimensions of the greatest variance; low and high span three deviations."""

    def sums(batches):
        for batch in batches:
            width = batch["vec"].map(len).max() if len(batch) else 0
            x = _matrix(batch["vec"], width).astype(np.float64)
            yield pd.DataFrame({"at": np.arange(width), "n": float(len(x)), "s": x.sum(0), "q": (x * x).sum(0)})

    parts = rows.select("vec").mapInPandas(sums, "at int, n double, s double, q double").groupBy("at")
    each = parts.agg(*[F.sum(c).alias(c) for c in "nsq"]).select("at", (F.col("s") / F.col("n")).alias("mean"), "n", "q")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    best = each.select("at", "mean", spread.alias("spread")).orderBy(F.desc("spread"), "at").limit(AXES).collect()
    return [(r["at"], r["mean"] - 3 * r["spread"], r["mean"] + 3 * r["spread"]) for r in best]


def _keyed(axes):
    def keys(batches):
        for batch in batches:
            cells = np.zeros((len(batch), len(axes)), np.int64)
            width = max([len(v) for v in batch["vec"]] + [at + 1 for at, _, _ in axes])
            x = _matrix(batch["vec"], width)
            for i, (at, low, high) in enumerate(axes):
                share = (x[:, at] - low) / max(high - low, 1e-9)
                cells[:, i] = np.clip(np.floor(share * (1 << BITS)), 0, (1 << BITS) - 1)
            yield batch.assign(key=hilbert_keys(cells, BITS) if axes else 0)

    return keys


def _cut(size, shard_blocks, width):
    """Sorted rows to blocks; a block is named by its first vec_id, a shard by its first block."""

    def block(rows, shard):
        rows = rows.sort_values("vec_id", kind="stable")
        x = _matrix(rows["vec"], width)
        return pd.DataFrame([{
            "shard": shard, "block": rows["vec_id"].iloc[0], "label": rows["label"].iloc[0], "key": rows["key"].min(),
            "low": x.min(0), "high": x.max(0), "ids": rows["vec_id"].to_numpy(), "anchors": rows["anchor"].to_numpy(),
            "vecs": x.tobytes(),
        }])

    def cut(batches):
        held, shard, n = None, None, 0
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch])
            if rows is None or not len(rows):
                continue
            labels = rows["label"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(rows)]
            starts = [s for a, b in itertools.pairwise(edges) for s in range(a, b, size)]
            ends = [*starts[1:], len(rows)]
            if batch is not None:
                held = rows.iloc[starts.pop():]  # may go on in the next batch
            for start, end in zip(starts, ends):
                piece = rows.iloc[start:end]
                shard, n = (piece["vec_id"].min(), 1) if n in (0, shard_blocks) else (shard, n + 1)
                yield block(piece, shard)

    return cut


def write_blocks(rows: DataFrame, size=BLOCK, shard_blocks=SHARD) -> DataFrame:
    """The block table of ``candidates``: shard, block, label, key, low, high, ids, anchors, vecs."""
    width = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    keyed = rows.mapInPandas(_keyed(spread_axes(rows)), "vec_id long, label long, vec array<int>, anchor boolean, key long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "key", "vec_id"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(dealt.mapInPandas(
        _cut(size, shard_blocks, width),
        "shard long, block long, label long, key long, low array<int>, high array<int>, ids array<long>, "
        "anchors array<boolean>, vecs binary",
    ))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer ``a @ b.T``."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("inner products may not fit 63 bits")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and greatest inner product of each anchor with any vector of each zone (zones x dimensions)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(up, low) + _products(down, high), _products(up, high) + _products(down, low)


def _stack(column, dtype=np.int64):
    return np.stack([np.asarray(v, dtype) for v in column])


def _vectors(block):
    return np.frombuffer(block["vecs"], np.int32).reshape(len(block["ids"]), len(block["low"]))


def own_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """anchor_id, label, key, vec, floor: the k-th best score in the anchor's own block, or null if there are fewer."""

    def seeds(batches):
        for batch in batches:
            for _, b in batch.iterrows():
                at = np.flatnonzero(b["anchors"])
                x = _vectors(b)
                scores = _products(x[at], x)
                scores[np.arange(len(at)), at] = -_MOST
                enough = x.shape[0] > k
                floors = np.partition(scores, -k, axis=1)[:, -k] if enough else [None] * len(at)
                yield pd.DataFrame({
                    "anchor_id": b["ids"][at], "label": b["label"], "key": b["key"], "vec": list(x[at]),
                    "floor": pd.array(floors, "Int64"),
                })

    some = blocks.filter(F.exists("anchors", lambda a: a)).select("label", "key", "low", "ids", "anchors", "vecs")
    return some.mapInPandas(seeds, "anchor_id long, label long, key long, vec array<int>, floor long")


def _windows(requests: pd.DataFrame):
    """Row of the request, number, low and high of each window."""
    n = [len(v) for v in requests["lows"]]
    row = np.repeat(np.arange(len(n)), n)
    number = np.concatenate([np.arange(k) for k in n])
    return row, number, np.concatenate(list(requests["lows"])).astype(np.int64), np.concatenate(list(requests["highs"])).astype(np.int64)


def _choosing(same):
    """(group, shard, block) of the zones that a window of the group may meet."""

    def choose(requests: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        if not len(requests) or not len(zones):
            return pd.DataFrame({"group": [], "shard": [], "block": []}, dtype="int64")
        row, _, lows, highs = _windows(requests)
        least, most = bounds(_stack(requests["vec"], np.int32), _stack(zones["low"], np.int32), _stack(zones["high"], np.int32))
        alike = requests["label"].to_numpy()[:, None] == zones["label"].to_numpy()[None, :]
        wanted = alike if same else ~alike
        met = ((most[row] >= lows[:, None]) & (least[row] <= highs[:, None]) & wanted[row]).any(0)
        return zones.loc[met, ["shard", "block"]].assign(group=requests["group"].iloc[0])[["group", "shard", "block"]]

    return choose


def _reading(same, k):
    """The k best (score down, vec_id up) in each window of each request, over the blocks that came."""

    def read(requests: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "number", "vec_id", "score"]
        if not len(requests) or not len(blocks):
            return pd.DataFrame({n: [] for n in names}, dtype="int64")
        row, number, lows, highs = _windows(requests)
        floors = lows.copy()
        x, own = _stack(requests["vec"], np.int32), requests["anchor_id"].to_numpy()
        least, most = bounds(x, _stack(blocks["low"], np.int32), _stack(blocks["high"], np.int32))
        alike = requests["label"].to_numpy()[:, None] == blocks["label"].to_numpy()[None, :]
        wanted = alike if same else ~alike
        best = [np.zeros(0, np.int64)] * 3  # window, -score, vec_id
        # Blocks that promise most come first, so that floors rise early.
        for at in np.argsort(-np.where(wanted, most, -_MOST).max(0), kind="stable"):
            b = blocks.iloc[at]
            open_ = np.flatnonzero(wanted[row, at] & (most[row, at] >= floors) & (least[row, at] <= highs))
            if not len(open_):
                continue
            asked, back = np.unique(row[open_], return_inverse=True)
            ids = np.asarray(b["ids"], np.int64)
            scores = _products(x[asked], _vectors(b))[back]
            inside = (scores >= floors[open_, None]) & (scores <= highs[open_, None]) & (ids[None, :] != own[row[open_], None])
            w, col = np.nonzero(inside)
            if not len(w):
                continue
            found = [np.concatenate(p) for p in zip(best, (open_[w], -scores[w, col], ids[col]))]
            order = np.lexsort((found[2], found[1], found[0]))
            found = [f[order] for f in found]
            firsts = np.searchsorted(found[0], found[0])
            place = np.arange(len(order)) - firsts
            best = [f[place < k] for f in found]
            full = found[0][place == k - 1]
            floors[full] = np.maximum(floors[full], -found[1][place == k - 1])
        return pd.DataFrame({
            "anchor_id": own[row[best[0]]], "number": number[best[0]], "vec_id": best[2], "score": -best[1]
        })

    return read


def best_in_windows(requests: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, number (of the window), rank, vec_id, score: the ``k`` best rows in each window.

    ``requests`` has group, anchor_id, label, vec, lows and highs (arrays: a window of scores each); rows
    of the anchor's label are searched if ``same``, of all others if not, never the anchor itself.
    """
    zones = blocks.select("shard", "block", "label", "low", "high")
    shards, groups = zones.agg(F.count_distinct("shard")).first()[0], requests.agg(F.max("group")).first()[0]
    deals = max(1, -(-shards // ZONES))
    left = requests.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    right = zones.withColumn("deal", F.pmod(F.xxhash64("shard"), F.lit(deals)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups or 0)))
    )
    picks = cut_lineage(left.groupBy("deal", "group").cogroup(right.groupBy("deal", "group")).applyInPandas(
        _choosing(same), "group int, shard long, block long"
    ))
    asked = requests.join(picks.select("group", "shard").distinct(), "group")
    read = blocks.join(picks.select("group", "block"), "block")
    found = asked.groupBy("group", "shard").cogroup(read.groupBy("group", "shard")).applyInPandas(
        _reading(same, k), "anchor_id long, number int, vec_id long, score long"
    )
    order = Window.partitionBy("anchor_id", "number").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ceiling(number: Column, by: int) -> Column:
    """Least whole number not below ``number / by``, in whole numbers."""
    by = F.lit(by).cast("long")
    return F.call_function("div", number + F.pmod(-number, by), by)


def mine(rows: DataFrame, positives=POSITIVES, negatives=NEGATIVES, share=SHARE, block=BLOCK, shard=SHARD, group=GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of ``candidates``.

    Negatives of a positive have another label and a score of ``share`` (a fraction) to all of its score.
    """
    blocks = write_blocks(rows, block, shard)
    anchors = cut_lineage(own_blocks(blocks, positives))
    groups = max(1, -(-anchors.count() // group))
    # Neighbours on the curve share a group: they tend to want the same blocks.
    grouped = cut_lineage(anchors.repartitionByRange(groups, "label", "key", "anchor_id").withColumn("group", F.spark_partition_id()))
    names = ["group", "anchor_id", "label", "vec"]
    first = grouped.select(
        *names, F.array(F.coalesce("floor", F.lit(-_MOST))).alias("lows"), F.array(F.lit(_MOST)).alias("highs")
    )
    kept = cut_lineage(best_in_windows(first, blocks, True, positives).select(
        "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    told = kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("told"))
    part, whole = share
    high = F.transform("told", lambda t: t["positive_score"])
    low = F.transform("told", lambda t: _ceiling(t["positive_score"] * part, whole))
    second = grouped.join(told, "anchor_id").select(*names, low.alias("lows"), high.alias("highs"))
    found = best_in_windows(cut_lineage(second), blocks, False, negatives).withColumn("place", F.col("number") + 1)
    return found.join(kept, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` for the rows whose vec_id is divisible by 100; every seventh label is one higher."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(candidates(embeddings, label, F.col("vec_id") % 100 == 0))
