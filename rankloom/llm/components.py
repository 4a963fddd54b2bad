"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common as C


def _jump(hook: DataFrame) -> DataFrame:
    """Every (component, to) leads on to where its target leads, if anywhere."""
    onward = hook.select(F.col("component").alias("to"), F.col("to").alias("further"))
    return hook.join(onward, "to", "left").select("component", F.coalesce("further", "to").alias("to"))


def connected(links: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, str]:
    """A saved table (id, component) of every node with a link, and its path; component is the smallest id that can be reached.

    ``links`` has the columns a and b. Every round each edge between two components hooks the greater label onto the
    least label it touches, and labels jump along two hooks, so that the rounds grow with the logarithm of the longest
    path. Minima are aggregated before the shuffle, so a node with very many links costs one row per task. A round is
    one job that writes the labels to the shared folder and counts the changes. Null ends are ignored. Labels that still
    change after ``most_rounds`` rounds are an error.
    """
    spark = links.sparkSession
    edges, edges_at = C.save(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # every node takes its least neighbour to begin with
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
    labels, at = C.save(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("component")), "labels")
    for _ in range(most_rounds):
        left = labels.withColumnsRenamed({"id": "a", "component": "ra"})
        right = labels.withColumnsRenamed({"id": "b", "component": "rb"})
        own = labels.where("id <> component").select(F.col("component").alias("lo"), F.col("id").alias("hi"))
        across = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi"))
        # a label may itself have moved on: its own hook takes part as well
        hook = across.union(own).groupBy(F.col("hi").alias("component")).agg(F.min("lo").alias("to"))
        onward = _jump(_jump(hook))
        moved, moved_at, seen = C.save_counted(
            labels.join(onward, "component", "left").select("id", F.coalesce("to", "component").alias("component"), "to"), "labels", changed=F.col("to").isNotNull())
        C.drop(spark, at)
        labels, at = moved.select("id", "component"), moved_at
        if not seen["changed"]:
            C.drop(spark, edges_at)
            return labels, at
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
