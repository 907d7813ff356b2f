"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow that gets service in proportion to its target. Its documents are shuffled (by a
hash of doc_id and text) and sent once per epoch; a document's virtual finish time is the source's words up to
its end, divided by the source's target. All copies are range-sorted by finish time, which interleaves the flows
to their weights, and a running sum truncates the sequence at the total budget, which is spent at virtual time 1:
the document that a source is sending at that moment is taken for the words that are through.

Targets: the budget, all words, is shared by weight; a source gets COPIES times its words at most,
and what it can't take is shared among the others by weight again, until nobody is above.

Words of a source are summed up per bucket of the hash, then over buckets, so a source that holds most
rows is spread over BUCKETS tasks. One row per source goes through a single task; that table is tiny.

Cases: a null text has size 0; documents and sources of size 0 are never taken; a null source is a
source of its own, the last; equal rows are queued one after another; an empty table stays empty.
"""

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .tables import packed, unpacked, words_of

#: By code point order of the sources, repeating; most copies of a document.
WEIGHTS, COPIES = (5, 2, 1), 3
#: Hex digits of the hash that make a bucket: 16 ** 3 buckets.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _size (words) and _shuffle (the place in the source's shuffle)."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return docs.withColumn("_size", size_of()).withColumn("_shuffle", F.md5(named.cast("binary")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, copies=COPIES) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, _size), and its place ``flow`` (from 0)."""
    sums = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    flow = F.row_number().over(order) - 1
    turn = F.array(*[F.lit(w).cast("long") for w in weights])[F.col("flow") % len(weights)]
    rows = sums.withColumn("flow", flow).withColumn("weight", turn).withColumn("cap", F.col("source_size") * copies)
    # By rising cap per weight: those before the first that isn't above its cap are at theirs.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "flow")
    left = rows.withColumns({
        "total": F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "full": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = left.withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("rest").cast("double"))
    holds = F.col("cap").cast("double") >= F.col("level") * F.col("weight")
    least = F.min(F.when(holds, F.struct(F.col("cap") / F.col("weight"), "flow", "level"))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("cap").cast("double"), least["level"] * F.col("weight"))
    return level.withColumn("target", target).select("source", "source_size", "target", "flow")


def queued(rows: DataFrame, sizes: DataFrame, weights=WEIGHTS, copies=COPIES) -> DataFrame:
    """``rows``, which are ``measured``, with _flow, _source_size, _target, _before (words before it in its source's
    shuffle) and _goal (words the source may send in all). ``sizes`` are the same rows without their texts."""
    flows = source_targets(sizes, weights, copies).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.col("flow").alias("_flow"), F.floor(F.col("target") + 0.5).cast("long").alias("_goal"),
    )

    def dealt(df):
        return df.join(flows, df["source"].eqNullSafe(flows["_source"])).withColumn("_bucket", F.left("_shuffle", F.lit(DIGITS)))

    inside = Window.partitionBy("_flow", "_bucket").orderBy("_shuffle", "_size").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_flow").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt(sizes).groupBy("_flow", "_bucket").agg(F.sum("_size").alias("_sum")).select(
        "_flow", "_bucket", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset")
    )
    placed = dealt(rows).withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return placed.join(sums, ["_flow", "_bucket"]).withColumn("_before", F.col("_inside") + F.col("_offset")).drop(
        "_source", "_inside", "_offset", "_bucket"
    )


def truncated(queue: DataFrame, copies=COPIES) -> DataFrame:
    """_flow and _through, the words of the copies that it sends whole, from the ``queued`` rows without their texts.

    All copies of all sources are range-sorted by virtual finish time. A running sum over the ranges, then within
    each, cuts the sequence where the budget is spent; copies still under way then (finish after time 1) aren't whole.
    """
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("_copy")
    sending = queue.filter("_size > 0").select("_flow", "_size", "_shuffle", "_source_size", "_before", "_target", epoch)
    end = F.col("_copy") * F.col("_source_size") + F.col("_before") + F.col("_size")
    timed = sending.select("_flow", "_size", "_shuffle", end.alias("_end"), (end / F.col("_target")).alias("_finish"))
    order = ["_finish", "_shuffle", "_end"]
    parts = int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(timed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_part").agg(F.sum("_size").alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_offset")
    )
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    spent = ranges.withColumn("_inside", inside).join(offsets, "_part").withColumn("_spent", F.col("_inside") + F.col("_offset"))
    budget = queue.agg(F.sum("_size").alias("_budget")).first()[0] or 0
    whole = spent.filter((F.col("_spent") <= budget) & (F.col("_finish") <= 1.0))
    return whole.groupBy("_flow").agg(F.sum("_size").alias("_through"))


def with_cut(queue: DataFrame, through: DataFrame) -> DataFrame:
    """The ``queue`` with _through of its flow, 0 if it sends no copy whole."""
    return queue.join(through, "_flow", "left").withColumn("_through", F.coalesce("_through", F.lit(0)))


def words_through(copy):
    """Words that the mix takes of a copy: all if it is sent whole, what is left of the goal if it is under way."""
    start = copy * F.col("_source_size") + F.col("_before")
    whole = start + F.col("_size") <= F.col("_through")
    under_way = (start == F.col("_through")) & (F.col("_size") > 0)
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_goal") - F.col("_through")))
    return F.when(whole, F.col("_size")).when(under_way, part).otherwise(0)


def sent(docs: DataFrame, weights=WEIGHTS, copies=COPIES) -> DataFrame:
    """The mix: ``docs`` once per copy that is taken, with _words (taken of this copy) and _finish.

    Finish times lie in (0, 1]. Sort by _finish, _shuffle for the interleaved order.
    """
    rows = measured(docs)
    sizes = cut_lineage(rows.select("source", "_size", "_shuffle"))
    through = truncated(queued(sizes, sizes, weights, copies), copies)
    cut = with_cut(queued(rows, sizes, weights, copies), cut_lineage(through))
    epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")), lambda k: words_through(k) > 0)
    copied = cut.withColumn("_copy", F.explode(epochs)).withColumn("_words", words_through(F.col("_copy")))
    # A copy that the truncation cuts is through at time 1.
    end = F.col("_copy") * F.col("_source_size") + F.col("_before") + F.col("_size")
    return copied.withColumn("_finish", F.least(F.lit(1.0), end / F.col("_target")))


def mix(docs: DataFrame, weights=WEIGHTS, copies=COPIES) -> DataFrame:
    """Rows of ``docs``, one per copy, range-sorted by virtual finish time.

    A cut copy keeps its first words, blank-joined, and n_chars, if there is one, counts what is kept.
    """
    names = ["doc_id", "source", "text"]
    rows = sent(packed(docs, names), weights, copies)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "_finish", "_shuffle").sortWithinPartitions("_finish", "_shuffle")
    cut = F.col("_words") < F.col("_size")
    head = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("_words").cast("int")), " ")
    changed = {"text": F.when(cut, head).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n_chars = F.char_length(head).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(cut, n_chars).otherwise(F.col("row").getField("n_chars"))
    return unpacked(ordered, docs, names, **changed)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, copies=COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and first_finish: when its first copy is through."""
    sizes = cut_lineage(measured(docs.select("doc_id", "source", "text")).drop("text"))
    queue = cut_lineage(queued(sizes, sizes, weights, copies))
    rows = with_cut(queue, truncated(queue, copies))
    words = functools.reduce(lambda a, b: a + b, [words_through(F.lit(k).cast("long")) for k in range(copies)])
    finish = F.when(F.col("_taken") > 0, F.least(F.lit(1.0), (F.col("_before") + F.col("_size")) / F.col("_target")))
    return rows.withColumn("_taken", words.cast("long")).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"), F.round(finish, 9).alias("first_finish"),
    )
