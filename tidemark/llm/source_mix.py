"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's share of the words of the mix is set by weights; it stops at a
multiple of the source's size, and what is cut off is shared again by weight.
The mix is dealt out in blocks of equally many words: blocks go to sources by
highest quotients target / (2k + 1), then, the same way, to shards of a source.
Documents of a shard lie in a seeded order, which is cut into blocks; the first
q blocks of a shard with quota q are taken, and once q passes the shard's
blocks, all are and the first of them again.  So a shard's choice has one edge
for each time it is gone through, and at most the document there is cut
(:func:`mix`), or taken or left whole, by the side its middle lies on
(:func:`take`).

All of it is DataFrame expressions.  How much of a document is taken follows
from its place in the shard in closed form, so blocks are never written out as
rows; the only wide operations are one shuffle of (id, source, size) and small
tables with a row a source or a shard.  Texts are shuffled only by
:func:`take`, and only where the numbers of rows left out or doubled are too
many to broadcast.

Defined results: a null text has size 0 and is taken 0 times; a null source is a
source of its own, after all others; rows that repeat an id each count; if all
sizes are 0, all targets are 0; an empty table gives an empty one.  A document
longer than a shard is a shard's only one, and no longer than any other to
compute.  Rows of a shard that has over ``shard_rows`` of them (null and
repeated ids go to one) are dealt again by their place in the table; then, and
only then, another partitioning of the table gives another, equally large choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import few, free_name, word_count
from tidemark.runtime import materialise, release
from tidemark.sources.tables import ROW, number_rows


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``: sources by code point, null last, weigh ``weights``, repeating.

    Sources are numbered by a distributed sort; each round of sharing is one
    aggregation and sets at least one more source to its limit.
    """
    per = number_rows(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col(ROW) % len(weights)).cast("int") + 1)
    per = materialise(per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, F.lit(False)
    while True:
        used, rest, over = per.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(~full)).first()
        if not over:
            return per.select("source", "source_size", F.col("cap").alias("target"))
        level = (total - (used or 0.0)) / rest
        now = F.col("w") * F.lit(level) >= F.col("cap")
        if not per.where(now & ~full).head(1):
            return per.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))
        full = now


def sainte_lague(shares: DataFrame, key: list[str], votes: str, seats: str, within: str | None = None) -> DataFrame:
    """``shares`` with ``quota``: ``seats`` (a column, constant within a group) dealt to rows by highest quotients of ``votes``.

    With V votes, N seats and m rows, a row of v votes has floor((v / q + 1) / 2)
    quotients of q or more: more than v / 2q - 1/2, at most v / 2q + 1/2, and at
    most v / q.  So fewer than N quotients exceed V / max(N, 2N - m) and at
    least N exceed V / (2N + m), whatever the votes.  Those above are seats for sure; those
    between, at most 3 m in all, are ranked.  Of equal quotients the
    one with the smaller key comes first, null last.
    """
    v, n = F.col(votes), F.col(seats)
    if within is None:
        total, rows = shares.agg(F.sum(votes), F.count("*")).first()
        known = shares.withColumn("__votes", F.lit(float(total or 0))).withColumn("__rows", F.lit(rows))
    else:
        per = shares.groupBy(F.col(within).alias("__group")).agg(F.sum(votes).alias("__votes"), F.count("*").alias("__rows"))
        known = shares.join(per, F.col(within).eqNullSafe(F.col("__group"))).drop("__group")
    low = F.col("__votes") / (2 * n + F.col("__rows")) * F.lit(1 - 1e-9)  # the margins are far above rounding
    high = F.col("__votes") / F.greatest(n, 2 * n - F.col("__rows")) * F.lit(1 + 1e-9)
    count = lambda q: F.when((n > 0) & (v > 0), F.floor((v / q + 1) / 2)).otherwise(0)
    known = known.withColumn("__sure", count(high)).withColumn("__most", count(low)).drop("__votes", "__rows")
    quotient = F.explode(F.sequence("__sure", F.col("__most") - 1)).alias("__k")
    names = list(dict.fromkeys([*key, *([within] if within else [])]))
    open_ = known.where("__most > __sure").select(*names, votes, seats, quotient).withColumn("__q", v / (2 * F.col("__k") + 1))
    order = [F.desc("__q"), *[F.asc_nulls_last(k) for k in key]]
    if within is None:
        left = known.agg(F.max(seats) - F.sum("__sure")).first()[0] or 0
        won = number_rows(open_.orderBy(*order)).where(F.col(ROW) < left)
    else:
        given = known.groupBy(F.col(within).alias("__group")).agg((F.max(seats) - F.sum("__sure")).alias("__left"))
        ranked = open_.withColumn("__n", F.row_number().over(W.partitionBy(within).orderBy(*order)))
        won = ranked.join(given, F.col(within).eqNullSafe(F.col("__group"))).where("__n <= __left")
    won = won.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias("__more"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = known.join(won, same, "left").withColumn("quota", (F.col("__sure") + F.coalesce("__more", F.lit(0))).cast("long"))
    return out.drop("__sure", "__most", "__more", *[f"__{k}" for k in key])


def _fraction(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``columns`` only."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


class Placed:
    """Every row's place in the mix: ``whole`` is the table as written, ``rows`` its rows without texts, each with its shard's quota."""

    def __init__(self, docs: DataFrame, columns: list[Column], text: str = "text", source: str = "source", id_column: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, block: int = 8, shard_words: int = 1 << 18, shard_rows: int = 1 << 18):
        names = docs.select(*columns).columns
        row, ident, key, size, digest = (F.col(c) for c in ("__row", "__id", "__source", "__size", "__digest"))
        self.whole = materialise(docs.select(*columns, F.col(id_column).alias("__id"), F.col(source).alias("__source"), word_count(text).alias("__size"), F.xxhash64(text).alias("__digest"), F.monotonically_increasing_id().alias("__row")), "sizes")
        slim = self.whole.drop(*names)
        goals = targets(slim.select(key.alias("source"), size.alias("size")), weights, share, most)
        goals = goals.withColumn("seats", F.round(F.lit(float(goals.agg(F.sum("target")).first()[0] or 0)) / block))
        goals = sainte_lague(goals, ["source"], "target", "seats").withColumnRenamed("quota", "blocks").drop("seats")
        goals = goals.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        self.goals = goals = materialise(goals, "goals")
        dealt = slim.join(goals, key.eqNullSafe(F.col("source")), "left").withColumn("shard", F.floor(_fraction(seed, F.lit("shard"), ident) * F.col("shards")).cast("long"))
        # at most as many shards as rows / shard_rows have too many rows
        crowded = dealt.groupBy(F.col("source").alias("c_source"), F.col("shard").alias("c_shard")).agg(F.ceil(F.count("*") / shard_rows).alias("parts")).where("parts > 1")
        crowded = materialise(crowded, "crowded")
        if crowded.head(1):
            dealt = dealt.join(few(crowded), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("shard") == F.col("c_shard")), "left").drop("c_source", "c_shard")
            part = F.pmod(F.xxhash64(row), F.coalesce("parts", F.lit(1)))
        else:
            part = F.lit(0)
        dealt = dealt.withColumn("part", part.cast("long"))
        shards = dealt.groupBy("source", "shard", "part", "blocks").agg(F.sum(size).cast("double").alias("words"))
        quotas = sainte_lague(shards, ["source", "shard", "part"], "words", "blocks", "source")
        quotas = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), F.col("part").alias("q_part"), "quota", F.col("words").cast("long").alias("words"))
        dealt = dealt.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")) & (F.col("part") == F.col("q_part")), "left")
        order = W.partitionBy("source", "shard", "part").orderBy(_fraction(seed, F.lit("order"), ident), ident, size, digest, row)
        dealt = dealt.withColumn("end", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("end") - size)
        quota = F.coalesce("quota", F.lit(0)) * block
        self.rows = dealt.withColumn("first", F.least(quota, "words")).withColumn("second", F.least(F.greatest(F.lit(0), quota - F.col("words")), "words"))


def mix(docs: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """One row a document: id, size, source_size, target (its source's, in words) and taken (words the mix takes).

    A shard takes its quota to the word, so of a document at an edge only the
    words before it are taken.  ``block`` words make a block, about
    ``shard_words`` words a shard.
    """
    rows = Placed(docs, [], id_column=id_column, **settings).rows
    taken = sum(F.least("end", q) - F.least("start", q) for q in ("first", "second"))
    return rows.select(F.col("__id").alias(id_column), F.col("__size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix holds them: a row for each time a document is taken, always whole.

    A document at an edge is taken if its middle lies before the edge, so a
    shard differs from its quota by at most half a document each time.
    """
    whole, times = free_name(docs, "whole"), free_name(docs, "times")
    placed = Placed(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)], **settings)
    middle = F.col("start") + F.col("end")
    count = sum(((F.col("__size") > 0) & (middle < 2 * F.col(q))).cast("int") for q in ("first", "second"))
    decided = materialise(placed.rows.select("__row", count.alias(times)).where(F.col(times) != 1), "times")
    release(placed.goals)
    rows = placed.whole.join(few(decided), "__row", "left").withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    again = rows.select(whole, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*[F.col(whole)[c].alias(c) for c in docs.columns])
