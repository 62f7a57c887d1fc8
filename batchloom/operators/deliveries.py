"""Deliveries of results: received under a lease, routed, committed, and acknowledged only when accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def receive(queue: DataFrame, n: int, now_s: int, lease_s: int = 0) -> tuple[DataFrame, DataFrame]:
    """(received, queue after) of a queue (seq, lease_until, ...): the first ``n`` deliveries that no unexpired lease holds.

    Under a lease they stay in the queue until they are acknowledged; without one (0) receiving takes them out.
    """
    free = queue.filter(F.col("lease_until").isNull() | (F.col("lease_until") <= now_s)).orderBy("seq").limit(n)
    got = free.select(F.col("seq").alias("__seq"))
    held = F.lit(now_s + lease_s if lease_s else None).cast("long")
    received = free.withColumn("lease_until", held)
    if not lease_s:
        return received, queue.join(got, F.col("seq") == F.col("__seq"), "left_anti")
    after = queue.join(got, F.col("seq") == F.col("__seq"), "left").withColumn("lease_until", F.when(F.col("__seq").isNotNull(), held).otherwise(F.col("lease_until")))
    return received, after.select(*queue.columns)


def acknowledge(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """The queue without acknowledged deliveries (seq); one that isn't there any more does no harm."""
    return queue.join(acks.select("seq").distinct(), "seq", "left_anti").select(*queue.columns)


def route_deliveries(deliveries: DataFrame, subscribers: DataFrame, open_batches: DataFrame) -> DataFrame:
    """Adds ``action``: deliver where any subscriber (batch_id) has the batch; else ack, if none of its entries is open, or hold."""
    live = subscribers.select("batch_id").distinct().withColumn("__live", F.lit(True))
    needed = open_batches.select("batch_id").distinct().withColumn("__open", F.lit(True))
    rows = deliveries.join(live, "batch_id", "left").join(needed, "batch_id", "left")
    return rows.withColumn("action", F.when(F.col("__live"), "deliver").when(F.col("__open"), "hold").otherwise("ack")).select(*deliveries.columns, "action")


def drain(deliveries: DataFrame, run: str, order: str = "seq") -> DataFrame:
    """Adds ``acked`` and ``error`` to commits (run, seq, owned, outcome): committed and duplicate ones are acknowledged until the run's
    first failure (conflict or error), which sticks: nothing after it is. Deliveries of other runs are left alone and stop nothing."""
    failed = F.col("owned") & F.col("outcome").isin("conflict", "error")
    before = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    first = F.min(F.when(failed, F.struct(order, "outcome"))).over(before)
    return deliveries.withColumn("__first", first).withColumns(
        {"acked": F.col("owned") & F.col("__first").isNull(), "error": F.when(F.col("owned"), F.col("__first.outcome"))}
    ).drop("__first")


def run_error(deliveries: DataFrame, run: str, order: str = "seq") -> DataFrame:
    """(run, error, acked) of each run: what its drain returns, null if all went well; lost ownership and a failed write are told apart."""
    rows = drain(deliveries, run, order)
    return rows.groupBy(run).agg(F.max("error").alias("error"), F.count_if("acked").alias("acked"))
