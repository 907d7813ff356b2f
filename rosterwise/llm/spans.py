"""Spans of patterns in texts, with DataFrame functions only and in time linear in the text.

Positions come from the gaps between matches: split and extract_all see the same matches, and sums of
their lengths, in blocks, give code points and bytes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries per block of the sums.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where a lambda in it runs many times."""
    return F.transform(F.array(value), body)[0]


def _blocks(values):
    return F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0)))


def _total(part):
    return F.aggregate(part, F.lit(0), lambda a, v: a + v)


def _block_sums(values: Column) -> Column:
    """For each block the sum of all blocks before it."""
    sums = F.transform(_blocks(values), lambda b: _total(F.slice(values, b * BLOCK + 1, BLOCK)))
    return let(sums, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b))))


def _upto(values: Column, sums: Column, i: Column) -> Column:
    """Sum of the first ``i`` values."""
    block = F.floor(i / BLOCK).cast("int")
    return sums[block] + _total(F.slice(values, block * BLOCK + 1, i % BLOCK))


def matches(rows: DataFrame, name: str, text: str, pattern: str, hint: str, before: int, after: int) -> DataFrame:
    """Adds ``name``: structs of hit, start, end (code points), low, high (bytes), before, after.

    ``hint`` must occur in a text that has a match; ``before`` and ``after`` are the most characters
    taken from the gaps on either side.
    """
    some = F.col(text).rlike(hint)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "_hits": F.when(some, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(none),
        "_gaps": F.when(some, F.split(text, pattern, -1)).otherwise(none),
    })
    rows = rows.withColumns({
        "_chars": F.transform("_hits", lambda h, i: F.char_length(h) + F.char_length(F.col("_gaps")[i])),
        "_bytes": F.transform("_hits", lambda h, i: F.octet_length(h) + F.octet_length(F.col("_gaps")[i])),
    })
    chars, size = F.col("_chars"), F.col("_bytes")

    def span(hit, i, char_sums, byte_sums):
        gap = F.col("_gaps")[i]
        start = _upto(chars, char_sums, i) + F.char_length(gap)
        low = _upto(size, byte_sums, i) + F.octet_length(gap)
        return F.struct(
            hit.alias("hit"), start.alias("start"), (start + F.char_length(hit)).alias("end"), low.alias("low"),
            (low + F.octet_length(hit)).alias("high"), F.right(gap, F.lit(before)).alias("before"),
            F.left(F.col("_gaps")[i + 1], F.lit(after)).alias("after"),
        )

    spans = let(_block_sums(chars), lambda c: let(_block_sums(size), lambda b: F.transform("_hits", lambda h, i: span(h, i, c, b))))
    return rows.withColumn(name, spans).drop("_hits", "_gaps", "_chars", "_bytes")


def running_max(values: Column) -> Column:
    """For each place the greatest value before it, 0 at first, by maxima of blocks."""

    def most(part):
        return F.coalesce(F.array_max(part), F.lit(0))

    def at(v, i, before, all_values):
        block = F.floor(i / BLOCK).cast("int")
        return F.greatest(before[block], most(F.slice(all_values, block * BLOCK + 1, i % BLOCK)))

    def spread(all_values):
        tops = F.transform(_blocks(all_values), lambda b: most(F.slice(all_values, b * BLOCK + 1, BLOCK)))
        before = let(tops, lambda t: F.transform(t, lambda _, b: most(F.slice(t, F.lit(1), b))))
        return let(before, lambda p: F.transform(all_values, lambda v, i: at(v, i, p, all_values)))

    return let(values, spread)


def free_of(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken`` (both structs with start and end, never empty spans).

    The ends of the spans and the starts of the taken ones are sorted together once; a span is free if
    no taken one that starts before its end reaches over its start.
    """
    none = F.lit(-1)
    ends = F.transform(spans, lambda s, i: F.struct(
        s["end"].alias("at"), F.lit(0).alias("side"), F.lit(0).alias("reach"), s["start"].alias("start"), i.alias("i")
    ))
    starts = F.transform(taken, lambda t: F.struct(
        t["start"].alias("at"), F.lit(1).alias("side"), t["end"].alias("reach"), none.alias("start"), none.alias("i")
    ))

    def judged(events):
        reach = running_max(F.transform(events, lambda e: e["reach"]))
        return let(reach, lambda r: F.transform(events, lambda e, i: F.struct(
            e["i"].alias("i"), (r[i] <= e["start"]).alias("free")
        )))

    verdicts = let(F.array_sort(F.concat(ends, starts)), lambda e: F.array_sort(F.filter(judged(e), lambda v: v["i"] >= 0)))
    free = let(verdicts, lambda v: F.filter(spans, lambda s, i: v[i]["free"]))
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(free)
