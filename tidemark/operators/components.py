"""Connected components of a link table, as DataFrame operations only.

Alternating large-star and small-star contraction (Kiveris et al., SoCC 2014).
Each round is two aggregations, combined before the shuffle, and two joins on long keys, in
which nodes of many links are broadcast (a bounded number), so that no task
gets a hub's links; every round ends in
a written table, so lineage stays short and a lost executor is survived.  No
link or component ever reaches the driver: only two numbers a round do, to
see whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialise, release


HUBS = 50_000  # at most so many keys are broadcast at once
LEAST = 64  # a key on fewer rows is never a hub


def look_up(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) inner-joined with ``table``, which has one row a key and, as ``count``, how many of ``rows`` have it.

    Keys on more than ``total / HUBS`` rows, at most HUBS of them, are
    broadcast; in the join that follows their rows are spread by a salt that finds nothing, so no task gets more
    than that many rows of one key.  ``count`` isn't in the result.
    """
    most = max(LEAST, -(-total // HUBS))
    values = F.struct(*[c for c in table.columns if c not in (key, count)])
    hubs = table.where(F.col(count) > most).select(key, values.alias("__hub"))
    others = table.where(F.col(count) <= most).select(key, F.lit(0).alias("__salt"), values.alias("__other"))
    salt = F.when(F.col("__hub").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1009))).cast("int")
    met = rows.join(F.broadcast(hubs), key, "left").withColumn("__salt", salt).join(others, [key, "__salt"], "left")
    found = F.coalesce("__hub", "__other")
    return met.where(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in table.columns if c not in (key, count)])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return look_up(both.where("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = look_up(down, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``.

    ``component`` is the smallest node id that can be reached; ids are longs.
    Links with a null end are ignored, a link from a node to itself makes the
    node known without linking it, repeated and reversed links count once.  An
    empty table gives an empty table.
    """
    known = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    known = materialise(known.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = known.select(F.col("u").alias("node")).union(known.select("v")).distinct()
    state, seen = known.where("u <> v"), None
    last, total = None, state.count()
    for _ in range(max_rounds):
        nxt = materialise(_small_star(_large_star(state, total), total), "stars")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None:
            release(last)
        last, state = nxt, nxt
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
