"""Rule checks on streams: one check per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import sniff


def sniff_stream(stream: DataFrame, checkpoint: str, on_stats: Callable[[int, dict], None]) -> StreamingQuery:
    """Start a query that hands the batch number and the rule statistics of every micro-batch to on_stats, once each.

    stream must have the flag column xsniff_passed.  A batch that is run again after a failure keeps its number, so
    on_stats can tell repetitions.
    """
    sniff.flag_column(stream)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: on_stats(n, sniff.stats(df).first().asDict())).start()
