"""Writers, and the reader of documents in parts. Each writes a folder of part files; nothing passes through the driver."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import part_counts


def write_reports(documents: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document per job and line."""
    documents.write.mode(mode).json(path)


def write_document_parts(parts: DataFrame, path: str, mode: str = "error") -> None:
    """Documents in parts (``report.document_parts``), sorted by job, rank and chunk, then a manifest of what there is.

    The parts of a document lie together, in a range of files; the manifest is counted from what was written,
    and written last, so a folder without it was cut off.
    """
    order = ["job_id", "rank", "chunk"]
    spark = parts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{path}/parts")
    part_counts(spark.read.schema(parts.schema).parquet(f"{path}/parts")).write.mode(mode).parquet(f"{path}/manifest")


def read_document_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts below ``path``; an error if any part or turn of the manifest is missing, or there is more."""
    parts, listed = spark.read.parquet(f"{path}/parts"), spark.read.parquet(f"{path}/manifest")
    names = ["job_id", "rank", "parts", "turns"]
    amiss = part_counts(parts).select(*names).exceptAll(listed.select(*names)).union(
        listed.select(*names).exceptAll(part_counts(parts).select(*names))
    )
    if amiss.select(F.lit(1)).limit(1).collect():
        raise ValueError(f"the parts at {path} are not those of its manifest")
    return parts


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error", partition_by=()) -> None:
    """Shortlists, summaries and pools as CSV with a header, or as Parquet."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported table format {fmt!r}; use csv or parquet")
