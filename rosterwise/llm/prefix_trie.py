"""Prefix trie of conversations: double arrays over shards of whole subtrees, shared upper nodes merged globally.

A node is a distinct sequence of first turns. Its key is its depth and a 128-bit sum of hashes of
(place, turn) along it, so keys come from running sums, in chunks of CHUNK places, and no task needs a whole
conversation. A node whose subtree has more than LIMIT turns (copies counted) is an upper node, like the
root; the subtrees below are whole and small. They are packed into shards of about LIMIT turns: turns get dense
ids, the trie goes into BASE and CHECK arrays, conversations are walked through those, and all figures of
the nodes come from there. Upper nodes are merged by key over all data: members by counts; leaves and
saved tokens by giving those of each top of a shard and of each upper node to its smallest member, summing
them up from the far end of that conversation, and adding over the members of every upper node. So a
first turn or a whole conversation that most rows share, or one conversation with most turns, is split.

Cases: rows without conv_id take no part; null role and text are empty; turns are ordered by turn (null
first), then role, text; repeated rows are turns like others; an empty table has no nodes; only conv_id,
turn, role and text are read, so other columns' names can't clash.
"""

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .tables import GAPS

#: Turns of a shard, and most turns of a subtree that goes into one.
LIMIT = 1 << 16
#: Places of a conversation that are summed in one group.
CHUNK = 1 << 16
#: Tasks that the rows of one upper node are spread over in joins.
SALTS = 16
#: Conversations are dealt into families by conv_id; one borrows up to HEADS - 1 turns of its family's first.
FAMILY, HEADS = 20, 4
#: Ids per piece of a list that is hashed; places tried for a node in the double array before its end is taken.
PIECE, TRIES = 4096, 512
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1, t2 (128 bits of role and text), words of each turn.

    A range sort of all turns, then numbers within each conversation's part of a range; only conversations that
    lie in several ranges (no more than there are ranges) need the counts of the ranges before.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.md5(F.concat_ws(":", F.char_length("role"), "role", "text").cast("binary"))
    words = F.size(F.filter(F.split("text", GAPS), lambda w: w != "")).cast("long")
    numbered = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64(F.lit(1), digest).alias("t1"), F.xxhash64(F.lit(2), digest).alias("t2"), words.alias("words"),
        F.monotonically_increasing_id().alias("at"),
    )).withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv_id", "part").count()
    offsets = counts.select("conv_id", "part", F.sum("count").over(before).alias("before")).filter("before > 0")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    return numbered.withColumn("inside", inside).join(offsets, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("place"), "t1", "t2", "words"
    )


def borrowed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, t1, t2, words, length: each conversation with the head of its family's first in place of its own.

    The head has crc32(conv_id) % HEADS turns. Depth 0 stands for the root, so conversations without turns are there too.
    """
    turns = cut_lineage(turns)
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({
        "first": F.col("conv_id") - F.col("conv_id") % FAMILY,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS,
    })
    turn = F.struct("place", "t1", "t2", "words")
    heads = turns.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("first")).agg(
        F.array_sort(F.collect_list(turn)).alias("head")
    )
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:long,t1:bigint,t2:bigint,words:bigint>>"))
    shift = F.col("h") - F.size("head")
    convs = cut_lineage(convs.join(heads, "first", "left").withColumn("head", head).select(
        "conv_id", "h", "n", "head", shift.alias("shift"), (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.size("head")).alias("length")
    ))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "words")], "length")
    lent = convs.select("conv_id", "length", F.explode("head").alias("s")).select(
        "conv_id", F.col("s.place").cast("long").alias("depth"), "s.t1", "s.t2", "s.words", "length"
    )
    chunk = F.floor(F.col("place") / CHUNK).cast("long")
    spread = convs.select("conv_id", "h", "shift", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.col("n") / CHUNK).cast("long")
    )).alias("chunk"))
    own = turns.withColumn("chunk", chunk).join(spread, ["conv_id", "chunk"]).filter("place > h").select(
        "conv_id", (F.col("place") - F.col("shift")).alias("depth"), "t1", "t2", "words", "length"
    )
    return root.union(lent).union(own)


def _running(rows: DataFrame, values: list[str], down: bool) -> DataFrame:
    """``rows`` with each of ``values`` summed up along its conversation to this row, from the far end if ``down``.

    Within chunks by a window; only conversations of several chunks need the sums of the chunks before.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK).cast("long"))

    def by(name):
        return F.col(name).desc() if down else F.col(name)

    inner = Window.partitionBy("conv_id", "chunk").orderBy(by("depth")).rangeBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy(by("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(F.col("length") >= CHUNK).groupBy("conv_id", "chunk").agg(*[F.sum(v).alias(v) for v in values])
    offsets = sums.select("conv_id", "chunk", *[F.sum(v).over(outer).alias(f"{v}_before") for v in values])
    total = {v: F.col(v) + F.coalesce(f"{v}_before", F.lit(0)) for v in values}
    summed = rows.withColumns({v: F.sum(v).over(inner) for v in values})
    return summed.join(offsets, ["conv_id", "chunk"], "left").withColumns(total).drop("chunk", *[f"{v}_before" for v in values])


def keyed_turns(rows: DataFrame) -> DataFrame:
    """``rows`` of ``borrowed`` with the key of their node (depth, k1, k2) and of its parent (p1, p2)."""
    low = F.lit((1 << 32) - 1)
    a, b = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "t1", "depth")
    pieces = {"s0": F.shiftrightunsigned(a, 32), "s1": a.bitwiseAND(low), "s2": F.shiftrightunsigned(b, 32), "s3": b.bitwiseAND(low)}
    pieces = {f"own_{k}": F.when(F.col("depth") > 0, v).otherwise(F.lit(0)) for k, v in pieces.items()}
    names = ["s0", "s1", "s2", "s3"]
    own = rows.withColumns(pieces)
    sums = _running(own.withColumns({n: F.col(f"own_{n}") for n in names}), names, False)

    def packed(high, rest):
        return F.shiftleft(high.bitwiseAND(low), 32).bitwiseOR(rest.bitwiseAND(low))

    now, past = [F.col(n) for n in names], [F.col(n) - F.col(f"own_{n}") for n in names]
    return sums.select(
        *rows.columns, packed(*now[:2]).alias("k1"), packed(*now[2:]).alias("k2"), packed(*past[:2]).alias("p1"), packed(*past[2:]).alias("p2")
    )


def _dealt(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with the unique ``keys`` of ``few``; rows of one key are dealt over SALTS tasks, ``few`` is copied to them."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    copied = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied, [*keys, "salt"], how).drop("salt")


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c, if check there is s. Codes are from 1."""

    def __init__(self, sequences):
        """``sequences``: lists of codes. States are placed from the root down."""
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        self.free, self.end = 1, 1  # the lowest place that may be free; all from the end on are
        level = [(0, sorted(s for s in sequences if s))]
        depth = 0
        while level:
            following = []
            for state, rows in level:
                runs = [(c, list(g)) for c, g in itertools.groupby(rows, key=lambda s: s[depth])]
                codes = np.array([c for c, _ in runs])
                at = self._place(codes)
                self.base[state] = at
                self.check[at + codes] = state
                self.end = max(self.end, int(at + codes[-1]) + 1)
                following += [(at + c, below) for c, g in runs if (below := [s for s in g if len(s) > depth + 1])]
            level, depth = following, depth + 1

    def _grown(self, size):
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, codes):
        """A base at which every code falls on a free place: the first from the lowest free one, or the end."""
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        # A base is 0 or more, so the first place to try lies at the first code or after it.
        at = max(self.free - int(codes[0]), 0)
        for at in range(at, at + TRIES):
            self._grown(at + int(codes[-1]) + 1)
            if (self.check[at + codes] < 0).all():
                return at
        at = max(self.end - int(codes[0]), 0)
        self._grown(at + int(codes[-1]) + 1)
        return at

    def walk(self, codes):
        """The states of a sequence, without the root; stops where there is no way on."""
        state = 0
        for c in codes:
            child = int(self.base[state]) + c
            if child >= len(self.check) or self.check[child] != state or child == 0:
                return
            state = child
            yield state


def _dense(values):
    """Dense codes from 1, in the order of first appearance."""
    seen = {}
    return [seen.setdefault(v, len(seen) + 1) for v in values]


_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, is_top boolean, p1 long, p2 long"
)


def shard_nodes(tails: list) -> pd.DataFrame:
    """Nodes of whole subtrees from ``tails``: (top key, conv_id, (p1, p2), [(t1, t2)], [words]), the top's turn first."""
    tops = {key: i for i, key in enumerate(dict.fromkeys(t[0] for t in tails), 1)}
    codes = iter(_dense([turn for t in tails for turn in t[3][1:]]))
    # The first code is the top's, the others come after those of all tops.
    sequences = [[tops[t[0]], *(len(tops) + next(codes) for _ in t[3][1:])] for t in tails]
    trie = DoubleArray(sequences)
    nodes, order = {}, []
    for (key, conv, parent_key, _, words), sequence in zip(tails, sequences):
        parent, node = None, None
        for i, state in enumerate(trie.walk(sequence)):
            node = nodes.get(state)
            if node is None:
                node = nodes[state] = {
                    "conv_id": conv, "depth": key[0] + i, "parent": parent, "n_convs": 0, "n_children": 0, "n_leaves": 0,
                    "saved_tokens": 0, "words": words[i], "ends": [], "key": parent_key,
                }
                order.append(node)
                if parent is not None:
                    parent["n_children"] += 1
            node["n_convs"] += 1
            node["conv_id"] = min(node["conv_id"], conv)
            parent = node
        node["ends"].append(conv)
    for node in reversed(order):
        node["n_leaves"] += node["n_children"] == 0
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if node["parent"] is not None:
            node["parent"]["n_leaves"] += node["n_leaves"]
            node["parent"]["saved_tokens"] += node["saved_tokens"]
    return pd.DataFrame([(
        n["conv_id"], n["depth"], n["parent"]["conv_id"] if n["parent"] else None, n["n_convs"], n["n_children"], n["n_leaves"],
        n["saved_tokens"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest(), n["parent"] is None, *n["key"],
    ) for n in order], columns=[c.split()[0] for c in _NODES.split(", ")]).astype({"parent_conv_id": "Int64"})


def _packed(limit):
    def pack(batches):
        held, turns, last = [], 0, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                key = (r.depth, r.k1, r.k2)
                if turns >= limit and key != last:
                    yield shard_nodes(held)
                    held, turns = [], 0
                last = key
                held.append((key, r.conv_id, (r.p1, r.p2), list(zip(r.t1, r.t2)), list(r.words)))
                turns += len(r.words)
        if held:
            yield shard_nodes(held)

    return pack


def _hashed_lists(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the comma-joined ascending conv_ids of each node.

    Ids are sorted by ranges and joined to pieces there; one task streams the pieces of a node, since a digest of a joined
    text can only be taken from its start to its end.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]

    def join(batches):
        for batch in batches:
            batch["piece"] = np.arange(len(batch)) // PIECE
            ids = batch.assign(ids=batch["conv_id"].astype(str)).groupby([*KEY, "piece"], sort=False)
            yield ids.agg(conv_id=("conv_id", "first"), ids=("ids", ",".join)).reset_index()[[*order, "ids"]]

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                now = (r.depth, r.k1, r.k2)
                if now != key:
                    out += [] if key is None else [(*key, state.hexdigest())]
                    key, state = now, hashlib.sha256(r.ids.encode())
                else:
                    state.update(b"," + r.ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    key_type = "depth long, k1 long, k2 long"
    pieces = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(join, f"{key_type}, conv_id long, ids string")
    return pieces.repartition(parts, *KEY).sortWithinPartitions(*order).mapInPandas(digest, f"{key_type}, ends_sha256 string")


def trie_nodes(rows: DataFrame, limit=LIMIT) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, depth from 0 for the root, t1, t2, words, length).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = cut_lineage(keyed_turns(rows))
    counted = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.sum(F.col("length") - F.col("depth") + 1).alias("turns"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "words")],
    )
    upper = cut_lineage(counted.filter((F.col("turns") > limit) | (F.col("depth") == 0)).drop("turns"))
    marked = cut_lineage(_dealt(rows, upper.select(*KEY, F.lit(True).alias("is_upper")), KEY, "left"))

    # Whole subtrees: the rest of each conversation has at most ``limit`` turns.
    said = F.struct("depth", "k1", "k2", "p1", "p2", "t1", "t2", "words")
    tails = marked.filter("is_upper IS NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("s"))
    first = F.col("s")[0]
    tails = tails.select(
        "conv_id", *[first[c].alias(c) for c in ("depth", "k1", "k2", "p1", "p2")], *[F.col("s")[c].alias(c) for c in ("t1", "t2", "words")]
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tails.repartition(parts, *KEY).sortWithinPartitions(*KEY, "conv_id")
    lower = cut_lineage(dealt.mapInPandas(_packed(limit), _NODES))

    # Upper nodes: children by parent key, then sums along the smallest member of what hangs there.
    tops = lower.filter("is_top")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = tops.select(*parent).union(upper.filter("depth > 0").select(*parent)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    upper = cut_lineage(upper.join(children, KEY, "left").na.fill(0, ["n_children"]))
    members = marked.filter("is_upper").select("conv_id", "length", *KEY)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    hanging = tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).union(upper.select(
        F.col("owner").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ))
    # Their length only tells whether a conversation has several chunks.
    items = hanging.select("conv_id", F.lit(CHUNK).cast("long").alias("length"), "depth", none.alias("k1"), none.alias("k2"), "leaves", "saved")
    both = members.withColumn("leaves", zero).withColumn("saved", zero).union(items)
    summed = _running(both, ["leaves", "saved"], True).filter("k1 IS NOT NULL").groupBy(*KEY).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    hashed = _hashed_lists(members.filter("depth = length"))
    names = upper.select(*KEY, F.col("owner").alias("parent_conv_id"))
    whole = upper.join(summed, KEY).join(hashed, KEY, "left").na.fill(EMPTY_SHA, ["ends_sha256"])
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = ["conv_id", "depth", "parent_conv_id", *columns]

    def with_parent(nodes):
        return _dealt(nodes.select("conv_id", *parent, F.col("depth").alias("own"), *columns), names, KEY, "left").select(
            "conv_id", F.col("own").alias("depth"), "parent_conv_id", *columns
        )

    return lower.filter("NOT is_top").select(*out).union(with_parent(tops)).union(with_parent(whole.withColumnRenamed("owner", "conv_id")))


def rebuilt_trie(conversations: DataFrame, limit=LIMIT) -> DataFrame:
    """``trie_nodes`` of the conversations as ``borrowed`` rebuilds them."""
    return trie_nodes(borrowed(ordered_turns(conversations)), limit)
