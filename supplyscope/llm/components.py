"""Connected components over a table of links: alternating large-star and small-star steps.

The union-find runs as joins and aggregates: each step replaces links by links to the smallest
neighbour, so a component of n nodes becomes a star around its smallest node after about
log n rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  Links stay
in tables: nothing about nodes reaches the driver but a row count and a checksum per round.
A hot node is the key of an aggregate with a map-side part, then the left side of a join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, materialize


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u > v)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(root, "u").select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l"))
    return small.select("l.u", "l.v").where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that has a link to another node; root is the component's smallest node.

    ``links`` holds pairs of longs in either order; repeated pairs, self-links and nulls are ignored.
    An empty table gives an empty result.  Raises if the links have not settled after ``max_rounds``.
    """
    now = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", narrow=True)
    mark = _signature(now)
    for _ in range(max_rounds if mark[0] else 0):
        after = materialize(_stars(now), "links", narrow=True)
        discard(now)
        now, before = after, mark
        mark = _signature(now)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"links have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
