"""Connected components of a graph given as links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage


#: Tasks that the links of one node are spread over where they meet its least neighbour.
SALTS = 32


def _with_least(links, least):
    """``links`` (a, b) with ``m`` of their ``a``; a hub's links are dealt out, its one row is copied."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copied = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copied, ["a", "salt"])


def _large(links):
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links):
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _kept(links):
    kept = cut_lineage(links.filter("a <> b").distinct())
    mark = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return kept, tuple(mark)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) reach, for each node that has a link.

    Each round is joins and combined minima over the links, kept as a table, so a hub is split like
    any skewed join and a lost executor replays one round. Only a count and a checksum come back.
    The number of rounds is logarithmic in practice. Null ends are dropped, links to oneself too.
    """
    kept, mark = _kept(links.select("a", "b").dropna())
    while True:
        stars, after = _kept(_small(_large(kept)))
        if after == mark:
            break
        kept, mark = stars, after
    roots = kept.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
