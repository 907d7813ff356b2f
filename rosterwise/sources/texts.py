"""Job descriptions and transcripts."""

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRANSCRIPTS


def job_id_below(path: str):
    """The file's path below the folder ``path``, without ``.txt``: files of other folders never share it."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_replace(F.col("_metadata.file_path"), "^.*?/" + re.escape(quote(root)) + "/", "")
    # A path that names one file, or a pattern, has no folder to cut: the file's name stands.
    name = F.when(below.contains(":/"), F.col("_metadata.file_name")).otherwise(below)
    return F.regexp_replace(name, r"\.txt$", "")


def read_jd_texts(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, raw_text``: one row per file below ``path``, named by its path there."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return texts.select(job_id_below(path).alias("job_id"), F.col("value").alias("raw_text"))


def read_transcripts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TRANSCRIPTS).format(fmt).load(path)
