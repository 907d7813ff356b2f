"""Helpers that the operators of this folder share."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterwise.session import cut_lineage

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
GAPS = r"[\x20\x09-\x0D]+"
#: Weight that half a long can't hold.
PACKED = 1 << 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``docs`` and ``row``, a struct of all its other columns, whose names can't clash with any in there."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*others) if others else F.lit(None)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, names: list[str], **changed) -> DataFrame:
    """The columns of ``docs`` from ``packed`` rows; ``changed`` columns take the place of those of their name."""
    return rows.select(*[
        changed.get(c, F.col(c) if c in names else F.col("row").getField(c)).alias(c) for c in docs.columns
    ])


def words_of(text: Column) -> Column:
    """Words between white space; one empty word where there is none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), GAPS)


def explode_shingles(df: DataFrame, text: Column, k: int, at="at", out="term") -> DataFrame:
    """One row for each run of ``k`` words, blank-joined, repeats included, with its place.

    A text of fewer words gives all of them as one term, a text without words the empty term.
    """
    n = F.size("_words")
    parts = df.withColumn("_words", words_of(text)).withColumns({
        f"_{i}": F.when(n >= k, F.slice("_words", i + 1, F.greatest(n - (k - 1), F.lit(0)))).otherwise(
            F.array(F.array_join("_words", " ") if i == 0 else F.lit(None).cast("string"))
        )
        for i in range(k)
    })
    names = [f"_{i}" for i in range(k)]
    rows = parts.select(*df.columns, F.posexplode(F.arrays_zip(*names)).alias(at, "_zipped"))
    return rows.select(*df.columns, at, F.concat_ws(" ", *[F.col(f"_zipped.{x}") for x in names]).alias(out))


def votes(df: DataFrame, keys: list[str], bits: str, weight: str, more=(), wide=False) -> DataFrame:
    """One row per key: ``fingerprint`` has each bit whose weighted share is over one half.

    Each sum counts bit i in its low and bit i + 32 in its high half, so 32 sums take 64 votes
    in one aggregation with map-side combine; nothing but the sums is shuffled. Halves hold a weight
    under PACKED; a key with more has a null fingerprint, unless ``wide`` gives every bit its own sum.
    """
    both = F.lit(1 if wide else 0x0000000100000001).cast("long")
    lanes = [
        F.try_sum(F.shiftright(F.col(bits), i).bitwiseAND(both) * F.col(weight)).alias(f"_v{i}") for i in range(64 if wide else 32)
    ]
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_all"), *more, *lanes)
    marks = []
    for i in range(64):
        lane = F.col(f"_v{i if wide else i % 32}")
        if not wide:
            lane = F.shiftrightunsigned(lane, 32) if i >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        value = 1 << i if i < 63 else -(1 << 63)
        marks.append(F.when(lane > F.col("_all") - lane, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    fingerprint = functools.reduce(lambda a, b: a.bitwiseOR(b), marks)
    if not wide:
        fingerprint = F.when(F.col("_all") < PACKED, fingerprint)
    kept = [c for c in sums.columns if c != "_all" and c not in {f"_v{i}" for i in range(len(lanes))}]
    return sums.select(*kept, fingerprint.alias("fingerprint"))


def all_votes(df: DataFrame, keys: list[str], bits: str, weight: str, more=()) -> DataFrame:
    """``votes``, kept as a table; the few keys of PACKED and more (many equal rows) vote again, in wide sums."""
    kept = cut_lineage(votes(df, keys, bits, weight, more))
    heavy = kept.filter(F.col("fingerprint").isNull()).select(*[F.col(k).alias(f"_heavy_{k}") for k in keys])
    if heavy.isEmpty():
        return kept
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_heavy_{k}")) for k in keys])
    again = votes(df.join(heavy, same, "left_semi"), keys, bits, weight, more, wide=True)
    return kept.filter(F.col("fingerprint").isNotNull()).unionByName(again)


def hex16(fingerprint) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def following(buckets: DataFrame) -> DataFrame:
    """``bucket`` (distinct longs) and ``next_bucket``, the next lower one; after the lowest the highest.

    Two levels: windows over 4096 neighbouring numbers, and one over the tops of those.
    """
    group = F.floor(F.col("bucket") / 4096).cast("long")
    rows = buckets.withColumn("_group", group)
    inner = rows.selectExpr(
        "bucket", "_group", "lead(bucket) OVER (PARTITION BY _group ORDER BY bucket DESC) AS _inner"
    )
    tops = rows.groupBy("_group").agg(F.max("bucket").alias("_top")).selectExpr(
        "_group",
        "coalesce(lead(_top) OVER (ORDER BY _group DESC), "
        "first_value(_top) OVER (ORDER BY _group DESC ROWS UNBOUNDED PRECEDING)) AS _outer",
    )
    return inner.join(tops, "_group").select("bucket", F.coalesce("_inner", "_outer").alias("next_bucket"))


def place(key: Column, ties: Column, chars: int = 64) -> Column:
    """Text whose ascending order is that of descending ``key`` (longs), then ``ties``; null keys last, by a hash.

    Of ``ties`` it has the first ``chars`` characters: rows equal in those have equal places.
    """
    named = F.concat(
        F.lit("0"), F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0"),
        F.coalesce(F.hex(F.substring(ties, 1, chars)), F.lit("")),
    )
    return F.coalesce(named, F.concat(F.lit("1"), F.lpad(F.hex(F.xxhash64(ties)), 16, "0")))


def bounds_of(places: DataFrame, parts: int, drawn: int = 20) -> list[str]:
    """Up to ``parts`` - 1 places that cut the rows into ranges of about equal counts, from a sample.

    A bound is cut to its key where the sampled row before it has another key.
    """
    n = places.count()
    sample = places.sample(min(1.0, drawn * parts / max(n, 1)), seed=7)
    seen = sorted(r[0] for r in sample.collect())
    cuts = sorted({len(seen) * i // parts for i in range(1, parts)} - {0})
    return sorted({seen[i] if seen[i - 1][:17] == seen[i][:17] else seen[i][:17] for i in cuts})


def bounds_below(place: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are not above ``place``, by halving; the result is a long."""
    if not bounds:
        return F.lit(0).cast("long")
    table = F.split(F.lit(",".join(bounds)), ",")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    step = lambda at, by: at + F.when(F.get(table, at + by - 1) <= place, by).otherwise(0)
    return F.aggregate(steps, F.lit(0), step).cast("long")


def with_next(rows: DataFrame, key: str, ties: str, times: int = 8) -> DataFrame:
    """Adds ``next``, a struct of the following row in descending ``key``; the first follows the last.

    Equal keys go by ``ties``, null keys come last, by a hash of ``ties``. Rows meet in ranges of
    their ``place``, ``times`` as many as there are shuffle partitions. The bounds come from a sample,
    so keys may lie anywhere, and a key of many rows is cut too; results don't hang on the bounds. A row
    travels once; the last row of a range gets the head of the next by a join that shuffles heads only.
    """
    names = rows.columns
    at = place(F.col(key), F.col(ties))
    parts = times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = bounds_of(rows.select(at.alias("_place")), parts)
    dealt = rows.withColumn("_place", at).withColumn("bucket", -bounds_below(F.col("_place"), bounds))
    window = f"OVER (PARTITION BY bucket ORDER BY _place, `{ties}` ASC NULLS FIRST)"
    packed = f"struct({', '.join(f'`{c}`' for c in names)})"
    inner = dealt.selectExpr("*", f"lead({packed}) {window} AS _inner")
    heads = dealt.selectExpr("bucket", f"{packed} AS _head", f"row_number() {window} AS _n").filter("_n = 1")
    links = following(dealt.select("bucket").distinct())
    outer = links.join(heads.select(F.col("bucket").alias("next_bucket"), "_head"), "next_bucket")
    return inner.join(outer.select("bucket", "_head"), "bucket", "left").select(
        *names, F.coalesce("_inner", "_head").alias("next")
    )


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the global order, which must have no ties.

    A range sort, kept as a table with its partition numbers, then counts of whole partitions
    added to row numbers within them: no task sees more than one range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    kept = cut_lineage(sorted_rows)
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_inside", inside).join(offsets, "_part").withColumn(
        "rank", F.col("_inside") + F.col("_before")
    ).drop("_part", "_inside", "_before")


def schema_of(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])
