"""Counting while files arrive (an addition: the engine's own input is bounded).

New Parquet files of (bc, umi, gene) in a folder are deduplicated across batches in
the state store; the stream of distinct molecules can be appended to a table on which
the batch operators run.  With ``ts`` and a watermark the state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "bc string, umi string, gene long, ts timestamp"


def distinct_stream(spark: SparkSession, folder: str, late: str = "1 day", schema: str = SCHEMA) -> DataFrame:
    own = spark.readStream.schema(schema).parquet(folder)
    return own.withWatermark("ts", late).dropDuplicatesWithinWatermark(["bc", "umi", "gene"])


def append_distinct(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """All that has arrived, once."""
    return distinct_stream(spark, folder, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
