"""Streams of patterns against a static collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixspark.functions.alphabet import fold
from helixspark.operators.sequences import windows
from helixspark.plans.index import Index


def count_stream(patterns: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Counts every micro-batch of ``patterns`` (query_id, pattern) and hands query_id, n to ``sink``."""
    return patterns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(index.parallel_count(batch), n)).start()


def locate_stream(patterns: DataFrame, index: Index, size: int) -> DataFrame:
    """A stream of query_id, sequence_idx, local_position for patterns of one length, by a stream-static join."""
    starts = windows(index.sequences, size).select(F.col("seq_idx").alias("sequence_idx"), F.col("pos").alias("local_position"), F.col("kmer").alias("folded"))
    asked = patterns.withColumn("folded", fold(F.col("pattern"), index.alphabet)).where(F.length("folded") == size)
    return asked.join(starts, "folded").select("query_id", "sequence_idx", "local_position")
