"""A candidate pool indexed once for discovery, kept as tables, extended by new pool files.

A segment holds the rows of the pool as they came, the distinct profiles with their first members, and postings: one row
per (profile, skill), stored in cells of one skill, experience bucket and location. A cell's bucket and location fix
what its profiles can get for experience and place, and its count of holders tells how rare they are, so the cells
are the blocks that discovery bounds before it reads postings. The first profiles of each experience value, place and cell
are kept apart. Profiles are numbered in pool order; a later segment's numbers are higher.

A pool that grows gets a further segment; earlier ones stay as they are. A profile that occurs in two segments is
listed in both, which costs places of a list but no results. A segment counts once its manifest is written, so
one that was cut off by a failure is left out, and written anew under the next number.
"""

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import NO_CANDIDATES
from ..functions.text import lowered
from ..schemas import NUMBERS
from ..session import shared_folder
from .cleaning import SchemaError

# The most held skills are compared as bits, BITS to a bigint; the others as strings.
WORDS, BITS = 4, 62
# Experience values outside 0..99 share a bucket on either side.
LAST_BUCKET = 100
# Copies of a profile, and heads of a list, that an index keeps unless told otherwise: the longest result list.
KEEP = 100
CELL = ["skill", "bucket", "c_loc"]
# Numbers of a segment: 2**17 partitions of up to 2**33 profiles.
SEGMENT_BITS = 50


def bucket_of(years: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(float(LAST_BUCKET)), years.cast("double"))).cast("int")


class SkillBits:
    """A sorted skill array as WORDS bigints of well-known skills and an array of the others."""

    def __init__(self, known: list[str]):
        self.words = [known[i * BITS : (i + 1) * BITS] for i in range(WORDS)]
        self.known = F.array(*[F.lit(s) for s in known]).cast("array<string>")

    def encode(self, df: DataFrame, skills: str, prefix: str) -> DataFrame:
        columns = {f"{prefix}_rare": F.array_except(skills, self.known)}
        for w, word in enumerate(self.words):
            columns[f"{prefix}_w{w}"] = self._bits(F.col(skills), word)
        return df.withColumns(columns)

    def encode_rows(self, held: DataFrame, key: str, prefix: str) -> DataFrame:
        """``key``, the words and the rare skills from (``key``, skill) rows, by a join with the known names."""
        names = [(s, w, 1 << i) for w, word in enumerate(self.words) for i, s in enumerate(word)]
        known = held.sparkSession.createDataFrame(names, "skill string, word int, bit long")
        coded = held.join(F.broadcast(known), "skill", "left")  # WORDS * BITS rows at most
        words = [
            F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"{prefix}_w{w}")
            for w in range(WORDS)
        ]
        rare = F.sort_array(F.collect_set(F.when(F.col("word").isNull(), F.col("skill")))).alias(f"{prefix}_rare")
        return coded.groupBy(key).agg(rare, *words)

    @staticmethod
    def _bits(skills: Column, word: list[str]) -> Column:
        if not word:
            return F.lit(0).cast("bigint")
        cells = [x for i, s in enumerate(word) for x in (F.lit(s), F.lit(1 << i).cast("bigint"))]
        table = F.create_map(*cells)
        zero = F.lit(0).cast("bigint")
        return F.aggregate(
            skills, zero, lambda m, s: m.bitwiseOR(F.coalesce(F.try_element_at(table, s), zero))
        )

    @staticmethod
    def common(a: str, b: str) -> Column:
        """How many skills ``a`` and ``b`` have in common."""
        known = [F.bit_count(F.col(f"{a}_w{w}").bitwiseAND(F.col(f"{b}_w{w}"))) for w in range(WORDS)]
        rare = F.when(
            F.size(f"{a}_rare") > 0, F.size(F.array_intersect(f"{a}_rare", f"{b}_rare"))
        ).otherwise(F.lit(0))
        return sum(known, rare)

    @staticmethod
    def disjoint(a: str, b: str) -> Column:
        known = [F.col(f"{a}_w{w}").bitwiseAND(F.col(f"{b}_w{w}")) == 0 for w in range(WORDS)]
        rare = (F.size(f"{a}_rare") == 0) | ~F.arrays_overlap(f"{a}_rare", f"{b}_rare")
        return reduce(lambda x, y: x & y, known) & rare


def candidate_profiles(candidates: DataFrame, keep: int) -> DataFrame:
    """Distinct profiles with their first ``keep`` members by pool order, numbered in that order (``c_no``)."""
    features = candidates.select(
        F.struct("pool_order", "candidate_id").alias("member"),
        F.sort_array(F.array_distinct(lowered(F.col("skills")))).alias("c_skills"),
        F.coalesce("experience_years", F.lit(0)).cast("double").alias("c_exp"),
        F.lower(F.coalesce("location", F.lit(""))).alias("c_loc"),
    ).withColumn("c_key", F.sha2(F.to_json(F.struct("c_skills", "c_exp", "c_loc")), 256))
    # row_number() <= keep is cut before the shuffle as well, so a profile that a third of
    # the pool shares sends `keep` rows per input partition.
    first = W.partitionBy("c_key").orderBy("member")
    profiles = (
        features.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= keep)
        .groupBy("c_key")
        .agg(
            F.first("c_skills").alias("c_skills"),
            F.first("c_exp").alias("c_exp"),
            F.first("c_loc").alias("c_loc"),
            F.sort_array(F.collect_list("member")).alias("members"),
        )
        .drop("c_key")
    )
    # A range sort numbers the profiles: ids of later partitions are higher.
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("members")[0]
    return profiles.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(
        "c_no", F.monotonically_increasing_id()
    )


def heads(rows: DataFrame, keys, keep: int) -> DataFrame:
    """The first ``keep`` rows by number of each key."""
    order = W.partitionBy(*keys).orderBy("c_no")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= keep)
        .drop("place")
    )


@dataclass(frozen=True)
class PoolIndex:
    """Segments below ``path``; ``skills`` are the well-known ones, ``keep`` bounds the length of a result list."""

    spark: SparkSession
    path: str
    segments: tuple
    skills: tuple
    keep: int
    rows: int

    def table(self, name: str) -> DataFrame:
        """``people`` as they came; ``profiles`` and ``postings`` with coded skills; ``cells`` with ``holders``; and more."""
        read = self.spark.read.parquet(*[f"{self.path}/segment-{s}/{name}" for s in self.segments])
        return read.groupBy(*CELL).agg(F.sum("holders").alias("holders")) if name == "cells" else read

    @property
    def people(self) -> DataFrame:
        return self.table("people")

    @property
    def bits(self) -> SkillBits:
        return SkillBits(list(self.skills))

    def heads(self, name: str, keys, keep: int) -> DataFrame:
        return heads(self.table(name), keys, keep)

    def extend(self, candidates: DataFrame) -> "PoolIndex":
        """The index with the rows of ``candidates`` behind those it has."""
        later = candidates.withColumn("pool_order", F.col("pool_order") + F.lit(self.rows))
        _write_segment(later, self.path, max(self.segments) + 1, self.keep, list(self.skills), self.rows)
        return open_index(self.spark, self.path)


def _write_segment(candidates, path, number, keep, skills, before):
    spark = candidates.sparkSession
    folder = f"{path}/segment-{number}"

    def kept(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # The pool is read here and nowhere else, and counted as it is written.
    seen = Observation()
    # One type in all segments: tables give whole numbers, JSON fractions.
    candidates = candidates.withColumns({c: F.col(c).cast("double") for c in NUMBERS if c in candidates.columns})
    people = kept(candidates.observe(seen, F.count(F.lit(1)).alias("rows")), "people")
    if number == 0 and not seen.get["rows"]:
        raise SchemaError(NO_CANDIDATES)
    bucket = bucket_of(F.col("c_exp")).alias("bucket")
    number_of = (F.col("c_no") + F.lit(number << SEGMENT_BITS)).alias("c_no")
    profiles = candidate_profiles(people, keep)
    raw = kept(profiles.select(number_of, "members", "c_skills", "c_exp", "c_loc"), "members")
    cells = kept(
        raw.select(F.explode("c_skills").alias("skill"), bucket, "c_loc").groupBy(*CELL).agg(F.count(F.lit(1)).alias("holders")), "cells"
    )
    if skills is None:
        held = cells.groupBy("skill").agg(F.sum("holders").alias("holders"))
        skills = [r.skill for r in held.orderBy(F.desc("holders"), "skill").limit(WORDS * BITS).collect()]
    held = raw.select("c_no", F.explode_outer("c_skills").alias("skill"))
    coded = SkillBits([*skills]).encode_rows(held, "c_no", "c")
    # Few bytes of profiles are many postings: in as many files as there are tasks for them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profiles = kept(raw.select("c_no", "c_exp", "c_loc", "c_skills").join(coded, "c_no").repartition(parts, "c_no"), "profiles")
    postings = profiles.withColumn("skill", F.explode("c_skills")).drop("c_skills").withColumn("bucket", bucket)
    profiles = profiles.drop("c_skills")
    # Files of a range of cells, sorted: a scan for some skills skips row groups by their bounds.
    tables = {
        "postings": postings.repartitionByRange(parts, *CELL, "c_no").sortWithinPartitions(*CELL, "c_no"),
        "by_years": heads(profiles, ["c_exp"], keep), "by_place": heads(profiles, ["c_loc", "c_exp"], keep),
    }
    with ThreadPoolExecutor(len(tables)) as pool:  # they don't hang on each other
        written = dict(zip(tables, pool.map(lambda name: kept(tables[name], name), tables)))
    # From the sorted files: what is in order already takes little sorting, and few files hold rows of a cell.
    kept(heads(written["postings"], CELL, keep), "by_cell")
    last = people.agg(F.coalesce(F.max("pool_order") + 1, F.lit(before))).first()[0]
    manifest = spark.range(1).select(
        F.lit(keep).alias("keep"), F.lit(last).cast("long").alias("rows"),
        F.array(*[F.lit(s) for s in skills]).cast("array<string>").alias("skills"),
    )
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def build_index(candidates: DataFrame, path: str | None = None, keep: int = KEEP) -> PoolIndex:
    """Index ``candidates`` below ``path`` (a new folder; one in the shared folder if it is not given).

    A pool without a row is an error, found by a count that rides on the write; later segments may be empty.
    """
    spark = candidates.sparkSession
    path = path or f"{shared_folder(spark)}/pool-index-{uuid.uuid4().hex}"
    _write_segment(candidates, path, 0, keep, None, 0)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PoolIndex:
    """The index that was built at ``path``, with all its whole segments."""
    found = []
    while True:
        try:
            rows = spark.read.schema("keep int, rows long, skills array<string>").json(f"{path}/segment-{len(found)}/manifest").collect()
        except AnalysisException:
            rows = []
        if not rows:
            break
        found.append(rows[0])
    if not found:
        raise ValueError(f"no index at {path}")
    return PoolIndex(spark, path, tuple(range(len(found))), tuple(found[0].skills), found[0].keep, found[-1].rows)
