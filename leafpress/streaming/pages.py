"""Page parsing over streams: the same stateless plan as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafpress.plans import pages as P


def read_pages(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", files: int = 16) -> DataFrame:
    """New Parquet files of pages as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def parse_stream(stream: DataFrame, out: str, checkpoint: str, once_per_url: str | None = None) -> StreamingQuery:
    """Parse a stream of pages into Parquet; ``once_per_url`` names the event time
    column by which repeated urls are dropped within a day's watermark."""
    if once_per_url:
        stream = stream.withWatermark(once_per_url, "1 day").dropDuplicatesWithinWatermark(["url"])
    parsed = P.parse(stream)
    return parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
