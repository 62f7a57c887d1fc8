"""Connected components by alternating large-star and small-star rounds; no component meets in one task, and nothing is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: a node's larger neighbours go to its smallest; small: its smaller ones do."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        out = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that aren't it. Edges (u, v) of long ids."""
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{label}-0")
    mark, k = None, 0
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == mark or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, k = sign, k + 1
        half = scratch.table(_star(now, True), f"{label}-{k}-large")
        new = scratch.table(_star(half, False), f"{label}-{k}")
        scratch.drop(f"{label}-{k}-large", f"{label}-{k - 1}")
        now = new
