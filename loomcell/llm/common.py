"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.storage import discard, materialise, shared_dir

__all__ = ["discard", "file_starts", "materialise", "row_key", "row_places", "session", "shared_dir", "table", "texts"]

#: Rows and bytes per Arrow batch, whichever is reached first; a single row may be larger.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The session of a DataFrame, with small Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def row_key(df: DataFrame):
    """A 64-bit digest of a whole row; equal rows have equal digests."""
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]  # maps have no hash
    return F.xxhash64(*own)


def row_places(df: DataFrame) -> tuple[Column, Column]:
    """Where a row lies in the order of ``df``: the name of its part, and the row in that from 0.

    Rows read from files lie in the order of the files, which tasks read cut up and in any
    order; the parts of any other DataFrame are its partitions.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            own = df.metadataColumn("_metadata")
            df.select(own["file_path"], own["row_index"])
            return own["file_path"], own["row_index"]
        except (AnalysisException, Py4JError):  # a source without files, or without rows' numbers
            pass
    return F.spark_partition_id().cast("string"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def file_starts(sizes: Mapping[str, int]) -> dict[str, int]:
    """The rows before each part, by name; numbers in names count as numbers, as part-100000 comes after part-99999."""
    starts, at = {}, 0
    for name in sorted(sizes, key=lambda x: [int(p) if k % 2 else p for k, p in enumerate(re.split(r"(\d+)", x))]):
        starts[name] = at
        at += sizes[name]
    return starts


def texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each Arrow batch with its text column as Python strings."""
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()
