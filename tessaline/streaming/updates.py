"""New matrix values as a stream: each micro-batch sums entries into a relation and gives the product's change.

A product is linear in the matrix, so the change of A x by a batch of entries is the product of the batch itself. The
running vector is a streaming aggregate whose state Spark keeps; nothing is computed again for old entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_spmv(entries: DataFrame, x: DataFrame) -> DataFrame:
    """A x over a stream of entries (i, j, v) so far, for a static vector x (i, v): a streaming aggregate by row."""
    xs = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return entries.join(xs, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def on_update(entries: DataFrame, solve: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls solve(batch, number) with each micro-batch of new values, once per batch after a restart as well."""
    return entries.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(solve).start()
