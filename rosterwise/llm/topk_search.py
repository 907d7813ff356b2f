"""Exact top-k inner products by MaxScore over shards.

Dimensions are terms, integer components are their weights in a vector; a term's postings for a query
are the vectors whose component has the sign of the query's, which add to the score. Per query and
shard, terms are ordered by their bounds (most that a vector of the shard can gain). Those whose bounds
together stay under the k-th best score are non-essential: a vector in none of the essential postings
can't be competitive. The others are scored over the essential terms and probed term by term
while their score plus the remaining bounds reaches the k-th best. Shards are merged by a window.

Queries meet vectors in blocks: SHARD vectors and BLOCK queries at a time, each pair of blocks a task of
its own, so no side is broadcast or collected and every task is bounded.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; shorter vectors are filled up with zeros; a repeated query id counts once (its smallest vector);
ties go to the smaller id; floor(256 x) of a component must fit 31 bits.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SHARD, BLOCK = 5, 4096, 4096
#: Vectors that are scored first, to have a threshold.
SEEDS = 64


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (array of long): floor(256 x) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def max_score(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(ids, scores) of the k best vectors: ``rows`` is dimensions x vectors, ``ids`` ascends."""
    bounds = np.maximum(np.where(query > 0, query * high, query * low), 0)
    order = np.argsort(-bounds, kind="stable")
    terms, bounds = order[bounds[order] > 0], bounds[order][bounds[order] > 0]
    other = ids != own
    # A threshold from the vectors that gain most by the first term.
    first = rows[terms[0]] * query[terms[0]] if len(terms) else np.zeros(len(ids), np.int64)
    seeds = np.argpartition(-first, SEEDS)[:SEEDS] if len(ids) > SEEDS else np.arange(len(ids))
    scores = query @ rows[:, seeds[other[seeds]]]
    least = np.partition(scores, -k)[-k] if len(scores) >= k else None
    if least is None or least <= 0:
        # No positive threshold: every vector may be among the best.
        alive = np.flatnonzero(other)
        partial = query @ rows[:, alive]
    else:
        rest = np.cumsum(bounds[::-1])[::-1]  # bound of a term and all after it
        essential = int(np.count_nonzero(rest >= least))
        lead, probes = terms[:essential], terms[essential:]
        posted = ((rows[lead] * np.sign(query[lead])[:, None]) > 0).any(0)
        alive = np.flatnonzero(posted & other)
        partial = query[lead] @ rows[np.ix_(lead, alive)]
        for at, term in enumerate(probes, essential):
            near = partial + rest[at] >= least
            if not near.all():
                alive, partial = alive[near], partial[near]
            partial = partial + query[term] * rows[term, alive]
        # Terms that can only lose are added last.
        losing = np.setdiff1d(np.arange(len(query)), terms)
        near = partial >= least
        alive, partial = alive[near], partial[near]
        partial = partial + query[losing] @ rows[np.ix_(losing, alive)]
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive][best], partial[best]


def _matrix(vectors, width):
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _searched(k):
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(vectors):
            width = max(map(len, [*queries["vec"], *vectors["vec"]]))
            vectors = vectors.sort_values("vec_id", kind="stable")
            ids, rows = vectors["vec_id"].to_numpy(), np.ascontiguousarray(_matrix(vectors["vec"], width).T)
            low, high = rows.min(1), rows.max(1)
            for own, query in zip(queries["vec_id"], _matrix(queries["vec"], width)):
                best, scores = max_score(query, own, ids, rows, low, high, k)
                found.append(pd.DataFrame({"query_id": own, "vec_id": best, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k=K, shard=SHARD, block=BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` for each of ``queries`` (vec_id, vec)."""
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    shards = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // block))

    def dealt(rows, own, n, other, m):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own)
        return rows.select("vec_id", "vec", mine, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(queries, "block", blocks, "shard", shards).groupBy("shard", "block")
    right = dealt(vectors, "shard", shards, "block", blocks).groupBy("shard", "block")
    found = left.cogroup(right).applyInPandas(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest(embeddings: DataFrame) -> DataFrame:
    """The best of all other rows for each row whose vec_id is divisible by 50."""
    rows = integer_vectors(embeddings)
    return top_k(rows.filter("vec_id % 50 = 0"), rows)
