"""Pages that keep arriving: each micro-batch replaces its URLs' chunks, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.ingest import Ingest


def arriving_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, markdown of the Parquet files that arrive under ``path``."""
    return spark.readStream.schema("url string, markdown string").parquet(path)


def keep_ingesting(pages: DataFrame, ingest: Ingest, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Of pages that arrive twice in a batch one is taken; ``available_now`` ends when all that is there has been read."""
    out = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest.run(df.dropDuplicates(["url"]), "stream") if not df.isEmpty() else None)
    return (out.trigger(availableNow=True) if available_now else out).start()
