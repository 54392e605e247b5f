"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import drop_written, written


#: A node with more links than this is large; so many of them at most (16 bytes each) are sent to all tasks.
LARGE, BROADCAST = 500, 1_000_000


def pointed(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the smallest ``b`` that ``sides`` (a, b) has for ``a``. Large nodes, counted first, are sent
    to all tasks, so that their edges stay where they are; the others' meet by node."""
    least = written(sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    large = least.where(F.col("n") > LARGE).select("a", F.col("m").alias("of_large"))
    few = large.limit(BROADCAST + 1).count()
    if not 0 < few <= BROADCAST:
        return edges.join(least.select("a", "m"), "a")
    split = edges.join(F.broadcast(large), "a", "left")
    rest = split.where("of_large IS NULL").select("a", "b").join(least.where(F.col("n") <= LARGE).select("a", "m"), "a")
    return rest.select("a", "b", "m").union(split.where("of_large IS NOT NULL").select("a", "b", "of_large"))


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``links`` (a long, b long): ``node``, ``root`` for every node of a link, where root is the smallest node
    that it reaches. Large-star and small-star steps in turn (Kiveris et al., 2014): every node points its
    larger neighbours, then its smaller ones and itself, at the smallest of all, until nothing changes. Each
    step is one aggregation and one join on the node; each round is written to the shared folder, and the driver
    sees only two sums."""

    def large(edges: DataFrame) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pointed(both.where("b > a"), both).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))

    def small(edges: DataFrame) -> DataFrame:  # here a > b holds in every row
        to = pointed(edges, edges)
        return to.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(to.select("a", F.col("m").alias("b"))).distinct()

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        starred = written(large(edges), "starred")
        new = written(small(starred), "links")
        now = new.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        drop_written(edges, starred)
        edges = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
