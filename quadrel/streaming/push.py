"""Push results to a callback, and quads that arrive in files into a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrel.sources.ntriples import blank_prefix, is_statement, read_lines


def push(result: DataFrame, handler: Callable[[Row], None]) -> int:
    """Calls the handler with each row, one partition in the driver's memory at a time; returns the number of rows."""
    n = 0
    for row in result.toLocalIterator():
        handler(row)
        n += 1
    return n


def load_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, graph: str | None = None, rejects: str | None = None) -> StreamingQuery:
    """Appends the N-Quads files that arrive in a folder to a Parquet table (s, p, o, g), each file once.

    Blank nodes of different files stay apart. Lines that are no statement go to the Parquet table `rejects` as
    (file, value); without one, such a line fails the query, as it does in batch reading. Each batch is written under
    its number, so a batch that runs again after a failure replaces what it wrote.
    """
    lines = spark.readStream.text(folder).select("value", F.input_file_name().alias("file"))

    def write(batch: DataFrame, number: int) -> None:
        if rejects is not None:
            good = is_statement(F.col("value"))
            batch.where(~good).select("file", "value").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            batch = batch.where(good)
        read_lines(batch, graph, blank_prefix(F.col("file"))).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
