"""Connected components of a graph given as pairs of ids, as rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import discard, settle


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for each node that has a link to another; component: its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing
    changes; each step replaces links by links to the smallest neighbour, so a path of n nodes
    takes O(log n) rounds in practice. A round groups by node with map-side minima, writes the
    minima and joins them back: both sides of such a join are plain shuffles, so AQE splits a
    hub's. Every round is a written table.

    Links with a null end and loops say nothing and are left out. No links: no rows.
    """
    pairs = (
        edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"), F.col(left).isNotNull().alias("l"), F.col(right).isNotNull().alias("r"))
        .where("l and r and hi != lo")
        .select("hi", "lo")
        .distinct()
    )
    now = settle(pairs, "links")
    seen = _digest(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = settle(large, "large")
        smallest = settle(large.groupBy("hi").agg(F.min("lo").alias("m")), "smallest")
        small = large.join(smallest, "hi").select(
            F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")
        )
        new = settle(small.select("x.hi", "x.lo").where("hi != lo").distinct(), "links")
        discard(now, least, large, smallest)
        now, before, seen = new, seen, _digest(new)
        if seen == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _digest(links: DataFrame) -> tuple:
    """Equal for equal sets of links, whatever their order."""
    h = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32))).first())
