"""Discovery: for every job, the best ``max_results`` candidates of the pool by a coarse score.

Scoring every job against every candidate does not scale, and an inverted index on skills
alone loses candidates who qualify on experience and location. This plan is exact and
never forms the product:

1. *Profiles.* Jobs with the same requirements, and candidates with the same skills,
   experience and location, score alike. Both sides shrink to distinct profiles; a
   candidate profile keeps its first K members by pool order (copies beyond K can never
   reach a top K). The candidates' side is a ``pool_index``, built once per pool. Pairs
   carry the numbers of their profiles, nothing else of them; members are looked up at the end.
2. *First list.* Per job profile: the first K profiles of each experience value, the first
   K of each (matching location, experience), and the first K holders of its rarest skill
   in range and in place.
   A candidate without any skill in common can only be in the result if it is among these:
   K profiles that come earlier in its own bucket score at least as much. The K-th best
   find so far is a floor for the final top K, by score and, at the same score, by pool order.
3. *Prefix.* Experience and location give at most 35 points, so a candidate that beats the
   floor needs ``floor - 35`` skill points. A job's skills are ordered from rare to common,
   and only the leading ones are joined with the postings, up to the point where the rest
   cannot make up those points. Each pair is met once, at its first common skill.
4. *Near join.* First on (skill, experience, location), which meets the candidates in range
   and in place. The pool is met in slices, first come first, each a few times as long as those before it: once
   a job has its K at the best score that can be had, later candidates cannot be among its best, so the work of a
   job ends with the slice that fills its list and does not grow with the pool behind it. All scores lift the floor.
5. *Far join.* All others lose ten points or more. Only the jobs and skills that can still
   reach the lifted floor without them are joined on the skill alone.
6. *Merge.* Best K of all lists per job profile, members unfolded, cut to K, joined back
   to the jobs.

Keys with many pairs are salted on both sides of either join, by counts taken beforehand.

Each list is cut to its best K and written by itself, the counts too: the best K of all lists are among the
best K of each, and the driver never plans or compiles more than one join at a time. Spark goes by the size of a
table's compressed files, so a small table whose rows are multiplied here would still be broadcast, through the
driver: joins with such rows ask for a merge join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import py_round1
from ..functions.text import anywhere, either_contains, lowered, present
from ..session import cut_lineage
from .pool_index import CELL, LAST_BUCKET, PoolIndex, SkillBits, bucket_of, build_index, heads

THRESHOLD = 25.0
BEST_OTHER = 35.0  # 20 experience + 15 location
NEXT_OTHER = 25.0  # 20 + 5 or 10 + 15
SLACK = 0.001  # float sums in bounds
# Counts are broadcast for this many keys at most; other keys count as rare, which costs
# order and balance, not results.
FREQUENT = 10_000
# A cell of the salted join: at most SEEKERS job rows, about PAIRS_PER_CELL pairs.
SEEKERS_PER_SALT = 1_000
PAIRS_PER_CELL = 250_000
# Profiles in the first slice of a pool for the near join; all slices so far are so many times as long with each further one.
FIRST_SLICE, LONGER = 65_536, 4
# A job location that matches more candidate locations than this is not part of the join
# key but of the condition.
KEYED_PLACES = 64


def _profile_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def job_features(jobs: DataFrame) -> DataFrame:
    """``job_id, j_key`` and what the discovery score reads of a job."""
    years = F.col("experience_years")
    out = jobs.select(
        "job_id",
        F.sort_array(F.array_distinct(lowered(F.col("required_skills")))).alias("j_req"),
        F.sort_array(F.array_distinct(lowered(F.col("nice_to_have")))).alias("j_nice"),
        F.lower(F.coalesce("location", F.lit("Any"))).alias("j_loc"),
        F.coalesce(years["min"], F.lit(0)).alias("j_min"),
        F.when(F.coalesce(years["max"], F.lit(0)) == 0, F.lit(10)).otherwise(years["max"]).alias("j_max"),
    )
    key = _profile_key(*[F.col(c) for c in out.columns[1:]])
    return out.withColumn("j_key", key).withColumn("j_anywhere", anywhere(F.col("j_loc")))


def experience_points() -> Column:
    exp = F.col("c_exp")
    return (
        F.when(exp.between(F.col("j_min"), F.col("j_max")), F.lit(20.0))
        .when(exp >= F.col("j_min") * 0.7, F.lit(10.0))
        .otherwise(F.lit(0.0))
    )


def location_points() -> Column:
    matches = F.col("j_anywhere") | either_contains(F.col("j_loc"), F.col("c_loc"))
    return F.when(matches, F.lit(15.0)).otherwise(F.lit(5.0))


def _share(hits: Column, wanted: Column, points: float) -> Column:
    return F.when(wanted > 0, hits / wanted * points).otherwise(F.lit(0.0))


def _scored(pairs: DataFrame, bar: Column) -> DataFrame:
    """Score a (job profile, candidate profile) pair; keep those at or over ``bar``."""
    return (
        pairs.withColumn("req_hits", SkillBits.common("j_req", "c"))
        .withColumn("nice_hits", SkillBits.common("j_nice", "c"))
        .withColumn("exp_points", experience_points())
        .withColumn("loc_points", location_points())
        .withColumn(
            "raw",
            F.lit(0.0)
            + _share(F.col("req_hits"), F.col("n_req"), 50.0)
            + _share(F.col("nice_hits"), F.col("n_nice"), 15.0)
            + F.col("exp_points")
            + F.col("loc_points"),
        )
        .filter(F.col("raw") >= bar)
        .withColumn("score", py_round1(F.col("raw")))
    )


PAIR = ["j_no", "c_no", "score", "req_hits", "nice_hits", "exp_points", "loc_points", "j_anywhere"]


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` distinct candidate profiles per job profile.

    The same pair may come from several branches with the same score: ``dense_rank`` gives
    the copies one place, so they are dropped after the cut, within at most ``keep`` places.
    """
    order = W.partitionBy("j_no").orderBy(F.desc("score"), "c_no")
    return (
        pairs.select(*PAIR)
        .withColumn("place", F.dense_rank().over(order))
        .filter(F.col("place") <= keep)
        .dropDuplicates(["j_no", "place"])
    )


def location_pairs(job_locations: DataFrame, cand_locations: DataFrame) -> DataFrame:
    """``j_loc, c_loc`` where one contains the other, from two tables of distinct locations.

    The shorter string's first three characters (or all of a shorter one) occur in the
    longer one: an equi-join on those grams, then the check.
    """

    def lead(loc):
        return F.substring(loc, 1, 3)

    def pieces(loc, n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(loc), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(loc, i, F.lit(n)))

    def grams(loc):
        every = F.concat(F.array(F.lit("")), *[pieces(loc, n) for n in (1, 2, 3)])
        return F.explode(F.array_distinct(every))

    j, c = F.col("j_loc"), F.col("c_loc")
    in_candidate = job_locations.select("j_loc", lead(j).alias("gram")).join(
        cand_locations.select("c_loc", grams(c).alias("gram")), "gram"
    ).filter(F.contains(c, j))
    in_job = job_locations.select("j_loc", grams(j).alias("gram")).join(
        cand_locations.select("c_loc", lead(c).alias("gram")), "gram"
    ).filter(F.contains(j, c))
    return in_candidate.unionByName(in_job).select("j_loc", "c_loc").distinct()


def _bucket_pairs(job_profiles: DataFrame, index: PoolIndex, places: DataFrame, keep: int) -> list[DataFrame]:
    """Every job profile with the head of each bucket its skill-less candidates can be in; by years, by place and years."""
    reach = F.least(F.col("j_min").cast("double"), F.col("j_min") * 0.7)
    last = F.when(F.col("j_anywhere"), F.lit(LAST_BUCKET)).otherwise(
        F.greatest(bucket_of(F.col("j_max")), bucket_of(reach))
    )
    by_years = job_profiles.withColumn("bucket", F.explode(F.sequence(bucket_of(reach), last)))
    first = index.heads("by_years", ["c_exp"], keep).withColumn("bucket", bucket_of(F.col("c_exp")))
    anywhere_pairs = by_years.join(first.hint("merge"), "bucket").drop("bucket")

    placed = job_profiles.filter(~F.col("j_anywhere"))
    local = places.join(index.heads("by_place", ["c_loc", "c_exp"], keep), "c_loc")
    local_heads = heads(local, ["j_loc", "c_exp"], keep).withColumn("bucket", bucket_of(F.col("c_exp")))
    local_pairs = (
        placed.withColumn("bucket", F.explode(F.sequence(bucket_of(reach), F.lit(LAST_BUCKET))))
        .join(local_heads.hint("merge"), ["j_loc", "bucket"])
        .drop("bucket")
    )
    return [anywhere_pairs, local_pairs]


def _job_skills(job_profiles: DataFrame) -> DataFrame:
    """One row per (job profile, skill) with the points the skill is worth."""

    def points(wanted, worth):
        return F.when(
            F.array_contains(wanted, F.col("skill")), F.lit(worth) / F.size(wanted)
        ).otherwise(F.lit(0.0))

    return job_profiles.withColumn(
        "skill", F.explode(F.array_union("j_req", "j_nice"))
    ).withColumn("worth", points(F.col("j_req"), 50.0) + points(F.col("j_nice"), 15.0))


def _busy(cells: DataFrame, seekers: DataFrame, keys) -> DataFrame:
    """Counts and salts of the keys with the most pairs; at most FREQUENT rows."""
    held = cells.groupBy(*keys).agg(F.sum("holders").alias("holders"))
    wanted = seekers.groupBy(*keys).agg(F.count(F.lit(1)).alias("seekers"))
    pairs = F.col("holders") * F.col("seekers").cast("double")
    j_salts = F.ceil(F.col("seekers") / F.lit(SEEKERS_PER_SALT))
    return (
        held.join(wanted, list(keys))
        .withColumn("pairs", pairs)
        .orderBy(F.desc("pairs"), *keys)
        .limit(FREQUENT)
        .withColumn("j_salts", j_salts.cast("int"))
        .withColumn("c_salts", F.ceil(F.col("pairs") / F.col("j_salts") / PAIRS_PER_CELL).cast("int"))
    )


def _prefix(job_skills: DataFrame, frequent: DataFrame, floors: DataFrame) -> DataFrame:
    """The leading skills of each job profile that a candidate over the floor must meet.

    ``rest``: points still to be had from this skill on; ``earlier``: the skills before it.
    """
    entry = F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "skill", "worth")
    ordered = (
        job_skills.select("j_no", "skill", "worth")
        .join(F.broadcast(frequent.select("skill", "holders")), "skill", "left")
        .groupBy("j_no")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    )

    def rest(at):
        tail = F.slice("entries", at + 1, F.size("entries"))
        return F.aggregate(tail, F.lit(0.0), lambda total, e: total + e.worth)

    placed = ordered.select("j_no", "entries", F.posexplode("entries").alias("at", "entry")).select(
        "j_no",
        F.col("entry.skill").alias("skill"),
        rest(F.col("at")).alias("rest"),
        F.transform(F.slice("entries", F.lit(1), F.col("at")), lambda e: e.skill).alias("earlier"),
    )
    return (
        placed.join(floors, "j_no", "left")
        .withColumn("bar", _bar())
        .filter(F.col("rest") + (BEST_OTHER + SLACK) >= F.col("bar"))
    )


def _bar() -> Column:
    """Least unrounded score of interest: a pair at the floor may still win its tie."""
    return F.greatest(F.coalesce("floor", F.lit(THRESHOLD)) - 0.05 - SLACK, F.lit(THRESHOLD))


def _floors(best: DataFrame, keep: int) -> DataFrame:
    """Score and order of the last of ``keep`` finds, for job profiles that have so many."""
    return best.filter(F.col("place") == keep).select(
        "j_no", F.col("score").alias("floor"), F.col("c_no").alias("last")
    )


def _pair_bar() -> Column:
    """The bar of a pair: one that comes after the last find must round to a better score."""
    earlier = F.col("last").isNull() | (F.col("c_no") < F.col("last"))
    return F.when(earlier, F.col("bar")).otherwise(F.greatest("bar", F.col("floor") + 0.05 - SLACK))


def _salted(rows: DataFrame, busy: DataFrame, keys, own: str, other: str, spread: Column) -> DataFrame:
    """Own salt from a hash, one copy per salt of the other side; 1 x 1 for rare keys."""
    n_own, n_other = f"{own}_salts", f"{other}_salts"
    return (
        rows.join(F.broadcast(busy.select(*keys, n_own, n_other)), list(keys), "left")
        .withColumn(f"{own}_salt", F.pmod(F.xxhash64(spread), F.coalesce(n_own, F.lit(1))).cast("int"))
        .withColumn(
            f"{other}_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)),
        )
        .drop(n_own, n_other)
    )


def _meet(seekers: DataFrame, postings: DataFrame, cells: DataFrame, keys, keep: int) -> DataFrame:
    """Best pairs with equal keys whose first common skill this is and whose bound reaches the bar."""
    busy = cut_lineage(_busy(cells, seekers, keys))
    left = _salted(seekers, busy, keys, "j", "c", F.col("j_no"))
    right = _salted(postings, busy, keys, "c", "j", F.col("c_no"))
    met = (
        left.join(right.hint("merge"), [*keys, "j_salt", "c_salt"])
        .filter(F.col("rest") + experience_points() + location_points() + SLACK >= F.col("bar"))
        .filter(SkillBits.disjoint("earlier", "c"))
    )
    return _list(met, _pair_bar(), keep)


def _list(pairs: DataFrame, bar: Column, keep: int) -> DataFrame:
    """The best of ``pairs`` that reach ``bar``, written."""
    return cut_lineage(_best(_scored(pairs, bar), keep)).select(*PAIR)


def _merged(lists: list[DataFrame], keep: int) -> DataFrame:
    return _best(reduce(DataFrame.unionByName, lists), keep)


def _keyed(seekers: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per experience value in range and, in the first result, per matching place.

    The second result holds the jobs whose place is no part of the key (``j_keyed``).
    """
    in_range = seekers.filter("j_min <= j_max")
    by_place = ~F.col("j_anywhere") & F.col("j_keyed")
    buckets = F.explode(F.sequence(bucket_of(F.col("j_min")), bucket_of(F.col("j_max"))))
    in_place = in_range.filter(by_place).join(places, "j_loc").withColumn("bucket", buckets)
    return in_place, in_range.filter(~by_place).withColumn("bucket", buckets)


def _near(seekers: DataFrame, postings: DataFrame, cells: DataFrame, places: DataFrame, keep: int) -> list[DataFrame]:
    """Pairs in experience range and, unless the job takes them from anywhere, in place."""
    in_place, others = _keyed(seekers, places)
    return [_meet(in_place, postings, cells, CELL, keep), _meet(others, postings, cells, CELL[:2], keep)]


def _slice_ends(index: PoolIndex) -> list[int]:
    """Numbers of profiles at which a slice of the pool ends and the next begins; where exactly is of no matter."""
    numbers = index.table("members").select("c_no")
    total, at = numbers.count(), FIRST_SLICE
    shares = []
    while at < total:
        shares.append(at / total)
        at *= LONGER
    ends = numbers.agg(F.percentile_approx("c_no", shares, 10_000)).first()[0] if shares else []
    return sorted(set(ends))


def _lifted(seekers: DataFrame, best: DataFrame, keep: int) -> DataFrame:
    """``seekers`` with the floors of ``best``."""
    return seekers.drop("floor", "last").join(_floors(best, keep), "j_no", "left").withColumn("bar", F.greatest("bar", _bar()))


def _near_by_slices(
    seekers: DataFrame, index: PoolIndex, cells: DataFrame, places: DataFrame, first: DataFrame, keep: int
) -> DataFrame:
    """``first`` and the near finds, merged; a slice is met by the jobs that what came before leaves a chance there."""
    postings, best, number = index.table("postings"), first, F.col("c_no")
    ends = _slice_ends(index)
    for low, high in zip([None, *ends], [*ends, None]):
        part = postings
        if low is not None:
            part = part.filter(number >= low)
            later = F.greatest("bar", F.when(F.col("last") < low, F.col("floor") + 0.05 - SLACK))
            seekers = cut_lineage(_spread(
                _lifted(seekers, best, keep).filter(F.col("rest") + (BEST_OTHER + SLACK) >= later)
            ))
        if high is not None:
            part = part.filter(number < high)
        near = _near(seekers, part, cells, places, keep)
        best = cut_lineage(_merged([best.select(*PAIR), *near], keep))
    return best


def _first_holders(
    job_skills: DataFrame, frequent: DataFrame, job_profiles: DataFrame, index: PoolIndex, places: DataFrame, keep: int
) -> list[DataFrame]:
    """Each job profile with the first holders of its rarest skill, in range and in place."""
    rarity = F.struct(F.coalesce("holders", F.lit(0)), "skill")
    rarest = (
        job_skills.join(F.broadcast(frequent.select("skill", "holders")), "skill", "left")
        .groupBy("j_no")
        .agg(F.min_by("skill", rarity).alias("skill"))
    )
    in_place, others = _keyed(cut_lineage(_spread(rarest.join(job_profiles, "j_no"))), places)
    return [
        in_place.join(index.heads("by_cell", CELL, keep).hint("merge"), CELL),
        others.join(index.heads("by_cell", CELL[:2], keep).hint("merge"), CELL[:2]),
    ]


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all shuffle partitions: few bytes of jobs mean many pairs, so small tables mustn't end in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "j_no")


def discover(jobs: DataFrame, candidates: DataFrame | PoolIndex, max_results: int = 20) -> DataFrame:
    """``job_id, candidate_id, discovery_rank, discovery_score, discovery_reason``.

    ``candidates`` is a pool, or its index, which has to keep ``max_results`` heads at least.
    """
    keep = max_results
    index = candidates if isinstance(candidates, PoolIndex) else build_index(candidates, keep=keep)
    if index.keep < keep:
        raise ValueError(f"the index keeps {index.keep} heads, {keep} are needed")
    features = cut_lineage(job_features(jobs))
    numbered = cut_lineage(
        features.drop("job_id").dropDuplicates(["j_key"]).withColumn("j_no", F.monotonically_increasing_id())
    )
    job_profiles = numbered.drop("j_key")
    job_skills = cut_lineage(_spread(_job_skills(job_profiles).select("j_no", "skill", "worth")))
    postings, cells = index.table("postings"), index.table("cells")
    frequent = cut_lineage(_busy(cells, job_skills, ["skill"]))
    places = cut_lineage(
        location_pairs(
            job_profiles.filter(~F.col("j_anywhere")).select("j_loc").distinct(),
            index.table("by_place").select("c_loc").distinct(),
        )
    )
    bits = index.bits
    job_profiles = bits.encode(bits.encode(job_profiles, "j_req", "j_req"), "j_nice", "j_nice")
    narrow = places.groupBy("j_loc").agg((F.count(F.lit(1)) <= KEYED_PLACES).alias("j_keyed"))
    job_profiles = cut_lineage(_spread(
        job_profiles.withColumn("n_req", F.size("j_req")).withColumn("n_nice", F.size("j_nice")).drop("j_req", "j_nice")
        .join(narrow, "j_loc", "left").withColumn("j_keyed", F.coalesce("j_keyed", F.lit(False)))
    ))

    first_pairs = _bucket_pairs(job_profiles, index, places, keep) + _first_holders(
        job_skills, frequent, job_profiles, index, places, keep
    )
    first = cut_lineage(_merged([_list(pairs, F.lit(THRESHOLD), keep) for pairs in first_pairs], keep))

    prefix = bits.encode(_prefix(job_skills, frequent, _floors(first, keep)), "earlier", "earlier")
    seekers = cut_lineage(_spread(prefix.drop("earlier").join(job_profiles, "j_no")))
    second = _near_by_slices(seekers, index, cells, places, first, keep)

    lifted = cut_lineage(_lifted(seekers, second, keep).filter(F.col("rest") + (NEXT_OTHER + SLACK) >= F.col("bar")))
    far = _meet(lifted, postings, cells, ["skill"], keep)

    unfold = W.partitionBy("j_no").orderBy(F.desc("score"), "member")
    top = (
        _merged([second.select(*PAIR), far], keep)
        .join(index.table("members").select("c_no", "members"), "c_no")
        .withColumn("member", F.explode("members"))
        .withColumn("discovery_rank", F.row_number().over(unfold))
        .filter(F.col("discovery_rank") <= keep)
        .select(
            "j_no",
            F.col("member.candidate_id").alias("candidate_id"),
            "discovery_rank",
            F.col("score").alias("discovery_score"),
            _reason().alias("discovery_reason"),
        )
    )
    keyed = features.select("job_id", "j_key").join(numbered.select("j_key", "j_no"), "j_key")
    return keyed.join(top, "j_no").drop("j_key", "j_no")


def _reason() -> Column:
    hits, nice = F.col("req_hits"), F.col("nice_hits")
    parts = present(
        F.when(hits >= 2, F.concat(hits.cast("string"), F.lit(" required skills match"))),
        F.when(nice >= 1, F.concat(nice.cast("string"), F.lit(" nice-to-have skills"))),
        F.when(F.col("exp_points") == 20, F.lit("Experience in range")).when(
            F.col("exp_points") == 10, F.lit("Experience close to range")
        ),
        F.when(~F.col("j_anywhere") & (F.col("loc_points") == 15), F.lit("Location match")),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("Partial skill match"))
