"""Connected components by alternating large and small stars.

Every round rewires links to the smallest node in reach and is written to the
shared folder, so a lost executor repeats one round at most.  A hub is never
gathered: its smallest neighbour comes from a combining aggregate, and the join
back is an equality join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.session import discard, materialize


def star(links: DataFrame, large: bool) -> DataFrame:
    """One half-round over links (a > b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        hung = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        hung = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Ends when a round changes no row; each round's table is deleted when the
    next one is written, the last one belongs to the result.
    """
    now = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"
    )
    size = now.count()
    while size:
        after = materialize(star(star(now, large=True), large=False), "stars")
        last, size = size, after.count()
        same = size == last and after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if same:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found.scratch_path = now.scratch_path
    return found
