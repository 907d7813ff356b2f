"""New job descriptions as a file stream, shortlisted against an indexed pool."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jd import extract_jobs
from ..operators.pool_index import PoolIndex
from ..plans.shortlist import build_shortlist, indexed
from ..sources.texts import job_id_below


def jd_text_stream(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.readStream.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(
            job_id_below(path).alias("job_id"),
            F.col("value").alias("raw_text"),
        )
    )


def shortlist_stream(
    texts: DataFrame, candidates: DataFrame | PoolIndex, vocabulary: DataFrame, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Write the flat shortlist of every batch below ``out``, one folder per batch.

    The pool is indexed once, before the first batch; batches read the index only. A batch that is run again
    after a failure replaces its own folder.
    """
    index = indexed(candidates, options.get("top_k", 10))

    def run(batch: DataFrame, batch_id: int) -> None:
        jobs = extract_jobs(batch, vocabulary)
        flat = build_shortlist(jobs, index, **options).flat()
        renamed = flat.toDF(*[c.lower().replace(" ", "_") for c in flat.columns])
        renamed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        texts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
