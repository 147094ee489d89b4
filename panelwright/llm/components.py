"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them (or the node itself).

    large: neighbours above the node; else the neighbours below it and the node.
    The minimum is aggregated map-side and joined back, so a hub is never one group.
    """
    seen = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = seen.join(low, F.col("a") == F.col("n"))
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    links: a, b (long). Rows with a null end or a = b say nothing. Each round is
    checkpointed in the shared folder; a round moves every node at least half
    way to its root. Nodes without links are not returned.
    """
    now = checkpointed(links.select("a", "b").where("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = checkpointed(_star(_star(now, large=True), large=False))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the stars did not settle in {rounds} rounds")
    # Settled: every link is (member, root).
    member = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return member.union(member.select(F.col("component").alias("node"), "component").distinct())
