"""Connected components by contraction to the smallest neighbour, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b): long ids -> (node, root) for every linked node; root is one id per component.

    Each round maps every node to its smallest neighbour (or itself), a combinable minimum, and rewrites the links
    between the images.  Ids are hashes, so the number of links falls by a constant factor a round even on paths.
    Every round is a written table; nothing of the graph reaches the driver but one row count.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "step")
        steps.append(step)
        ends = edges.join(step.select(F.col("a"), F.col("to").alias("x")), "a")
        ends = ends.join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        pairs = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = materialize(pairs.distinct(), "edges")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    out = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        later = step.select(F.col("a").alias("root"), "to")
        out = out.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def extend_components(comp: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components after more links: only the links between the roots of comp(node, root) are contracted."""
    if comp is None:
        return materialize(connected_components(new), "components")
    ends = new.join(comp.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
    ends = ends.join(comp.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    more = connected_components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    more = materialize(more, "merged")
    old = comp.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    old = old.select("node", F.coalesce("to", "root").alias("root"))
    return materialize(old.unionByName(more.join(comp, "node", "left_anti")), "components")


#: Random orders of nodes by which alike buckets find each other.
ORDERS = 3


def united(rows: DataFrame) -> DataFrame:
    """rows(key, n, node, root), n: rows of the bucket -> the same columns, with alike buckets made one where that has no
    more pairs than they have together.

    Near sets share dozens of buckets, which hold nearly the same sets.  Buckets with the same least node in a random
    order are united (alike ones agree with a chance that is their similarity), so each pair is met a few times instead
    of in every bucket.  No pair of a bucket is lost, and buckets that share few sets stay as they are.
    """
    for order in range(ORDERS):
        least = rows.groupBy("key").agg(F.min(F.xxhash64("node", F.lit(order))).alias("least"))
        rows = materialize(rows.join(least, "key"), "grouped")
        whole = rows.groupBy("least").agg(F.sum("n").alias("work"), F.countDistinct("node").alias("sets"))
        rows = rows.join(whole.where("sets * sets <= work").select("least", "sets"), "least", "left")
        one = rows.where("sets IS NOT NULL").groupBy("least", "node").agg(F.min("sets").alias("n"), F.min("root").alias("root"))
        apart = rows.where("sets IS NULL").select("key", "n", "node", "root")
        rows = materialize(apart.unionByName(one.withColumnRenamed("least", "key")), "united")
    return rows
