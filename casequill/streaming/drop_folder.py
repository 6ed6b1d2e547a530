"""Drop-folder ingest: uploads as a file stream.

Operators that are projections per row or paragraph (detection, masks, paragraph rules)
run on the stream itself. Operators with state across rows (rename conflicts, totals) run
per micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_folder(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", pattern: str | None = None
) -> DataFrame:
    """Stream of the files in a landing directory. The schema is explicit; files are taken once."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_table(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """Stream of a table that is one file or a folder of files. A plain path must be a folder, so the
    path is given as a pattern that matches nothing else; Spark then lists either."""
    path = path.rstrip("/")
    return spark.readStream.format(fmt).schema(schema).load(f"{path[:-1]}[{path[-1]}]")


def run_available(
    stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Process everything that is there and stop; exactly-once into files."""
    return (
        stream.writeStream.format(fmt)
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """The same for operators that need a whole batch; ``handle`` must be idempotent per batch id."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
