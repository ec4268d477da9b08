"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.shared import drop, save


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in links(a, b), both long: the component is its smallest node.

    Large-star hangs the larger neighbours of each node on its smallest neighbour, small-star the smaller ones; when neither
    changes the edges, each component is a star. Only counts and checksums reach the driver.
    """
    edges = save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = save(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(lowest, "b")
        new = hung.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(lowest.select(F.col("m").alias("a"), "b")).distinct()
        new = save(new, "edges")
        drop(edges, large)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
