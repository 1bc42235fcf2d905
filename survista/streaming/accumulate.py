"""A / E of lives that arrive as a stream. A, E and V are sums over lives, so batches of new lives add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from survista.functions import ieee
from survista.operators.aev import accumulate, clipped, elements_of, measure
from survista.operators.settings import resolve
from survista.sources.data import ExpData


def stream_aev(data: ExpData, mortality, table: str, checkpoint: str, include=None, weight=None, breakdown=None, overdispersion=1.0, time_scale=None, once: bool = True) -> StreamingQuery:
    """Running sums of a streaming ExpData (made with verify=False) into the Parquet folder `table`, complete after each
    trigger. Spark keeps one row an element as state; a life must arrive once."""
    omega, step = resolve(None, overdispersion, time_scale)
    m = measure(data, mortality, weight)
    elements = elements_of(include, breakdown)
    sums = accumulate(clipped(data, elements, m.fields), data.scope(), m, step)
    sums = sums.withColumn("V", F.col("V") * ieee.lit(omega))

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(table)

    writer = sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
