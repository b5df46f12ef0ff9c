"""Connected components of links between integers, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkronym.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(v, label) for every end of an edge (x, y): the smallest vertex that can be reached.

    Each step takes the smallest label among a vertex and its neighbours and then that
    label's own label, so that chains shorten by halves. Labels are written after each
    step. Minima are taken on the map side first: a vertex of many edges is no hot key
    of an aggregation, and joins on it may be split."""
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both = scratch.save(both.where("x <> y").distinct(), f"{name}-edges")
    lab = scratch.save(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        near = both.join(lab, both.y == lab.v).groupBy("x").agg(F.min("label").alias("near"))
        new = lab.join(near, lab.v == near.x, "left").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lab.select(F.col("v").alias("w"), F.col("label").alias("over"))
        new = new.join(up, new.label == up.w, "left").select("v", "old", F.least("label", "over").alias("label"))
        step += 1
        new = scratch.save(new, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        lab = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            scratch.drop(f"{name}-edges")
            return lab
