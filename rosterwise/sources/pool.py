"""Candidate pools from CSV, JSON and Parquet."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import ORDER, clean_pool, require_rows, validate_schema
from ..schemas import CANDIDATES

JSON_POOL = T.StructType(
    [T.StructField("id", T.StringType())]
    + [f for f in CANDIDATES.fields if f.name not in ("candidate_id", ORDER)]
)


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``pool_order``, the row number from 0 over the files in path order.

    ``df`` is a plain file scan. A row's number is its place within its file split plus the
    rows of the splits before it, so it does not depend on how files are split or which task
    reads them. The only unpartitioned step runs over one row per split.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = rows.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        rows.join(splits, ["_path", "_start"])
        .withColumn(ORDER, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_path", "_start", "_at", "_first", "_n", "_before")
    )


def scan_pool(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw rows of a pool; the format follows the file ending unless it is given."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    if fmt == "json":
        return spark.read.schema(JSON_POOL).option("multiLine", True).json(path)
    if fmt == "jsonl":
        return spark.read.schema(JSON_POOL).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported pool format {fmt!r}; use csv, json, jsonl or parquet")


def read_pool(spark: SparkSession, path: str, fmt: str | None = None, strict: bool = False) -> DataFrame:
    """Candidates of a pool file or folder.

    JSON keeps its values as they are, numbers with their fractions; tables go through :func:`clean_pool`, and with
    ``strict`` their header must have exactly the 17 fields and a valid row must follow. A table may bring its own
    ``pool_order``; otherwise rows are numbered in file order.
    """
    raw = scan_pool(spark, path, fmt)
    ordered = raw if ORDER in raw.columns else with_file_order(raw)
    if raw.schema == JSON_POOL:
        people = ordered.withColumnRenamed("id", "candidate_id")
        return people.select(*CANDIDATES.names)
    if strict:
        validate_schema(raw)
        return require_rows(clean_pool(ordered))
    return clean_pool(ordered)


def open_pool(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """The given path, else ``candidates.csv`` of the folder, else its ``candidates.json``."""
    if path:
        return read_pool(spark, path)
    try:
        return read_pool(spark, f"{folder}/candidates.csv")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_pool(spark, f"{folder}/candidates.json")
