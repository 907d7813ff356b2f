"""Statistics of a candidate pool."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.numbers import py_round1


def pool_stats(candidates: DataFrame) -> DataFrame:
    """One row: size, distinct locations, mean experience and salary (one decimal, 0 if empty)."""

    def mean1(column):
        whole = isinstance(candidates.schema[column].dataType, IntegralType)
        total = F.sum(F.coalesce(column, F.lit(0)).cast("bigint" if whole else "double"))
        return F.coalesce(py_round1(total / F.nullif(F.count(F.lit(1)), F.lit(0))), F.lit(0.0))

    return candidates.agg(
        F.count(F.lit(1)).alias("total_candidates_in_pool"),
        F.count_distinct(F.coalesce("location", F.lit("Unknown"))).alias("unique_locations"),
        mean1("experience_years").alias("avg_experience"),
        mean1("salary_expectation_lpa").alias("avg_salary"),
    )


def pool_locations(candidates: DataFrame) -> DataFrame:
    """Distinct locations with their counts, one row each rather than one long list."""
    return (
        candidates.groupBy(F.coalesce("location", F.lit("Unknown")).alias("location"))
        .agg(F.count(F.lit(1)).alias("candidates"))
    )


def top_locations(candidates: DataFrame, n: int = 5) -> DataFrame:
    return pool_locations(candidates).orderBy(F.desc("candidates"), "location").limit(n)


def experience_band(years: Column) -> Column:
    return (
        F.when(years <= 2, F.lit("Junior (1-2 years)"))
        .when(years <= 5, F.lit("Mid (3-5 years)"))
        .when(years <= 8, F.lit("Senior (6-8 years)"))
        .otherwise(F.lit("Lead (9+ years)"))
    )


def experience_bands(candidates: DataFrame) -> DataFrame:
    band = experience_band(F.coalesce("experience_years", F.lit(0)))
    return candidates.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("candidates"))


def source_files(pool: DataFrame) -> DataFrame:
    """Name, size in KB (one decimal) and rows of every file a pool is read from."""
    return (
        pool.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("size"),
        )
        .groupBy("path", "file_name", "size")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("file_name", py_round1(F.col("size") / 1024).alias("file_size_kb"), "rows")
    )
