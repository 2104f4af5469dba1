"""Connected components of links within pages, in rounds that grow with the
logarithm of a component's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.session import durable


def connected(links: DataFrame, page: str) -> tuple[DataFrame, int]:
    """(page, node, root) for every node of ``links`` (page, a, b; whole numbers), root
    being the smallest node reachable, and the rounds it took.

    A round hooks every root that is not the smallest of its neighbours onto the
    smallest one, so at least half of the trees that still have links end, and then
    follows pointers, each step doubling the way, until every node names its root.
    Links whose ends have met are dropped, so rounds get cheaper. What a step leaves
    is written to the shared folder."""
    links = durable(links.where("a <> b").select(page, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parents = durable(links.select(page, F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    rounds = 0
    while not links.isEmpty():
        rounds += 1
        ends = links
        for end in ("a", "b"):
            ends = ends.join(parents.select(page, F.col("node").alias(end), F.col("root").alias(f"_{end}")), [page, end])
        open_ = durable(ends.where("_a <> _b").select(page, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        hooks = open_.groupBy(page, F.greatest("a", "b").alias("top")).agg(F.min(F.least("a", "b")).alias("below"))
        shallow = parents.join(hooks.withColumnRenamed("top", "root"), [page, "root"], "left").select(page, "node", F.coalesce("below", "root").alias("root"))
        parents, settled = durable(shallow), False
        while not settled:  # pointers are followed until every node names a root
            up = parents.select(page, F.col("node").alias("root"), F.col("root").alias("_up"))
            parents = durable(parents.join(up, [page, "root"]).select(page, "node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")))
            settled = parents.where("moved").isEmpty()
            parents = parents.select(page, "node", "root")
        links = open_
    return parents, rounds
