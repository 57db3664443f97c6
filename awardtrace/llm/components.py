"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import stage
from awardtrace.operators.joins import skew_join


def _with_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least of u and its neighbours; u with many edges is split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    return skew_join(edges, least.select("u", F.least("u", "low").alias("low")), ["u"])


def components(edges: DataFrame) -> DataFrame:
    """``u, component``: the least vertex that each vertex of the edges (u, v: long) reaches.

    Large stars hang the larger neighbours of a vertex below its least one, small stars
    the smaller ones; every round is written to the shared folder. The rounds end when
    the edges stay the same, after some log of the longest path.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                  "component-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .where("u <> v").distinct())
        large = stage(large, "component-large")
        small = _with_least(large)
        small = (small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        edges = stage(small, "component-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
