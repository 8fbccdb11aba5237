"""Recursion over tables: what can be reached, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch


def reach(links: DataFrame, seeds: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``(node, steps)``: what ``seeds(node)`` reach over ``links(source, target)``, with the fewest steps.

    Each step joins the links to what the last one found, and what is new goes on, as a table in the shared folder: so a step's work is that of its
    own frontier, nothing is found twice, circles end, and no step recomputes an earlier one. Null nodes reach nothing. Nodes of a hot
    target are made one in each task before they are shuffled.
    """
    scratch = Scratch(links.sparkSession, "reach")
    links = links.where("source is not null and target is not null").select("source", "target")
    frontier = scratch.table(seeds.where("node is not null").select("node").distinct())
    visited, steps = frontier.withColumn("steps", F.lit(0).cast("long")), 0
    while (most_steps is None or steps < most_steps) and not frontier.isEmpty():
        steps += 1
        found = links.join(frontier, links["source"] == frontier["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = scratch.table(found.join(visited.select("node"), "node", "left_anti"))
        visited = visited.unionByName(frontier.withColumn("steps", F.lit(steps).cast("long")))
    return visited
