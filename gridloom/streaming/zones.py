"""Features that arrive as a stream, against rasters at rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.plans.zonal import zonal_stats


def stream_zonal_stats(features: DataFrame, rasters, ops, sink: Callable[[DataFrame, int], None], checkpoint: str, weights=None, **options) -> StreamingQuery:
    """Each micro-batch of features gets its statistics, which go to ``sink(result, batch id)``.

    A feature is complete by itself, so no state and no watermark is needed;
    a sink that writes by batch id is exact once. The query is started with a
    checkpoint folder and processes what is there (``availableNow``) unless
    ``trigger`` says otherwise.
    """
    trigger = options.pop("trigger", {"availableNow": True})

    def batch(df: DataFrame, number: int) -> None:
        sink(zonal_stats(rasters, df, ops, weights=weights, **options), number)

    return features.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
