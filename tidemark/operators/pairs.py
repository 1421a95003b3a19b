"""Similarity self-joins as equi-joins on grid cells, over distinct points.

A condition like abs(xi - xj) <= t alone would be planned as a Cartesian
product.  Here one side is copied to the neighbouring cells of a grid, both are
joined on the cell, and the exact condition is tested on what meets.  Rows with
equal values are one point with a count, so a heap of exact duplicates costs one
row and their pairs are counted, not written out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import ROW


def pair_budget(n: int, limit: int) -> None:
    needed = n * (n - 1) // 2
    if needed > limit:
        raise ValueError(f"A pair check over {n} rows makes {needed} comparisons, exceeding max_pair_comparisons={limit}; raise the limit or choose fewer rows.")


def points(values: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct points of ``values`` (ROW and ``columns``): point (its first row), times, last, and the columns."""
    return values.groupBy(*columns).agg(F.min(ROW).alias("point"), F.count("*").alias("times"), F.max(ROW).alias("last"))


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("double") if width else x


def _near_cells(x: Column, width: float) -> Column:
    cell = F.floor(x / F.lit(width)).cast("double")
    return F.array_distinct(F.array(cell - 1, cell, cell + 1))  # far from 0 neighbours may be the same double


def _met(pts: DataFrame, columns: list[str], widths: dict[str, float], equal: list[str], condition: Column) -> DataFrame:
    a = pts.select(F.col("point").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns], *[_cell(F.col(c), w).alias(f"cell_{c}") for c, w in widths.items()], *[F.col(c).alias(f"cell_{c}") for c in equal])
    b = pts.select(F.col("point").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns], *[F.col(c).alias(f"cell_{c}") for c in equal])
    for c, w in widths.items():
        b = b.withColumn(f"cell_{c}", F.explode(_near_cells(F.col(f"b_{c}"), w)))
    on = [f"cell_{c}" for c in [*equal, *widths]]
    return a.join(b, on).where((F.col("a") < F.col("b")) & condition).select("a", "b")


def band_pairs(pts: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of points that differ by at most the tolerance in every column."""
    columns = list(tolerances)
    equal = [c for c, t in tolerances.items() if t == 0]
    widths = {c: 2.0 * t for c, t in tolerances.items() if t > 0}
    grid = dict(list(widths.items())[:2])
    within = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= F.lit(float(t)) for c, t in tolerances.items()]
    if not grid:  # distinct points can't be equal in every column
        return pts.where("false").select(F.col("point").alias("a"), F.col("point").alias("b"))
    return _met(pts, columns, grid, equal, reduce(lambda x, y: x & y, within))


def radius_pairs(pts: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of points at most ``radius`` apart."""
    if radius == 0:
        return pts.where("false").select(F.col("point").alias("a"), F.col("point").alias("b"))
    squares = [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]
    distance = F.sqrt(reduce(lambda x, y: x + y, squares))
    grid = dict.fromkeys(columns[:3], radius * 1.000001)  # rounding must not part neighbours
    return _met(pts, columns, grid, [], distance <= F.lit(float(radius)))


def neighbour_counts(values: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """``(ROW, neighbours)``: other rows within ``radius``, for every row of ``values``."""
    pts = points(values, columns)
    pairs = radius_pairs(pts, columns, radius)
    times = pts.select("point", "times")
    both = pairs.select(F.col("a").alias("at"), F.col("b").alias("point")).unionByName(pairs.select(F.col("b").alias("at"), F.col("a").alias("point")))
    more = both.join(times, "point").groupBy(F.col("at").alias("point")).agg(F.sum("times").alias("others"))
    counts = pts.join(more, "point", "left").select(*columns, (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("neighbours"))
    return values.join(counts, columns).select(ROW, "neighbours")


def tanimoto_pairs(pts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, score)`` of points whose fingerprints ``fp`` (array of long) reach the Tanimoto threshold.

    A score of t needs numbers of set bits within a factor of t, so both sides
    are joined on cells of their logarithm.
    """
    ones = F.aggregate("fp", F.lit(0), lambda s, x: s + F.bit_count(x))
    width = -math.log(threshold) * 1.000001 if threshold < 1 else 0.0
    level = F.log(F.greatest(ones, F.lit(1)).cast("double"))
    own = pts.where(ones > 0).select("point", "fp", ones.alias("ones"), level.alias("level"))
    a = own.select(F.col("point").alias("a"), F.col("fp").alias("fa"), F.col("ones").alias("na"), (_cell(F.col("level"), width) if width else F.col("ones").cast("double")).alias("cell"))
    b = own.select(F.col("point").alias("b"), F.col("fp").alias("fb"), F.col("ones").alias("nb"), (F.explode(_near_cells(F.col("level"), width)) if width else F.col("ones").cast("double")).alias("cell"))
    common = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    score = common / (F.col("na") + F.col("nb") - common)
    return a.join(b, "cell").where(F.col("a") < F.col("b")).select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


class PairSummary:
    """What pairs of points mean for rows: numbers of pairs, rows in them, the first pairs.

    ``members``: (ROW, point, label), a row a row, label null where unknown;
    ``links``: (a, b[, score]) between different points.  Rows of one point pair with
    each other with score 1.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.scored = "score" in links.columns
        self.members, self.links = members, links
        pts = members.groupBy("point").agg(F.count("*").alias("times"), F.max(ROW).alias("last"), F.min("label").alias("low"), F.max("label").alias("high"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        beyond = both.join(pts.withColumnRenamed("point", "b"), "b").groupBy(F.col("a").alias("point")).agg(F.sum("times").alias("others"), F.max("last").alias("far"), F.min("low").alias("o_low"), F.max("high").alias("o_high"))
        self.points = pts.join(beyond, "point", "left").select(
            "point", "times", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("partners"), F.greatest("last", "far").alias("reach"), F.least("low", "o_low").alias("low"), F.greatest("high", "o_high").alias("high")
        )

    def count(self) -> int:
        twice = self.points.agg(F.coalesce(F.sum(F.col("times") * F.col("partners")), F.lit(0))).first()[0]
        return int(twice) // 2

    def rows(self) -> DataFrame:
        return self.members.join(self.points.where("partners > 0").select("point"), "point", "left_semi").select(ROW)

    def crossing_count(self) -> int:
        per = self.members.where("label IS NOT NULL").groupBy("point", "label").agg(F.count("*").alias("k"))
        totals = per.groupBy("point").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"))
        within = totals.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0))).first()[0]
        ends = self.links.select("a", "b")
        product = ends.join(totals.select(F.col("point").alias("a"), F.col("n").alias("na")), "a").join(totals.select(F.col("point").alias("b"), F.col("n").alias("nb")), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0))).first()[0]
        same = ends.join(per.select(F.col("point").alias("a"), "label", F.col("k").alias("ka")), "a").join(per.select(F.col("point").alias("b"), "label", F.col("k").alias("kb")), ["b", "label"]).agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0))).first()[0]
        return int(within) + int(product) - int(same)

    def crossing_rows(self) -> DataFrame:
        met = self.members.where("label IS NOT NULL").join(self.points, "point")
        return met.where("(low <> label) OR (high <> label)").select(ROW)

    def examples(self, crossing: bool, most: int = 100) -> list[list]:
        """The first pairs in order of rows.

        Only rows with a partner after them can lead a pair; the first few are
        expanded, more only if their pairs (those that cross) don't suffice.
        """
        met = self.members.join(self.points, "point").where(F.col("reach") > F.col(ROW))
        if crossing:
            met = met.where("label IS NOT NULL AND (low <> label OR high <> label)")
        score = [F.col("score")] if self.scored else []
        links = self.links.select("a", "b", *score).unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"), *score))
        others = self.members.select(F.col(ROW).alias("j"), F.col("point").alias("b"), F.col("label").alias("lj"))
        few = most
        while True:
            leaders = met.orderBy(ROW).limit(few).select(F.col(ROW).alias("i"), F.col("point").alias("a"), F.col("label").alias("li"))
            own = leaders.select("i", "li", F.col("a").alias("b"), *([F.lit(1.0).alias("score")] if self.scored else []))
            pairs = own.unionByName(leaders.join(links, "a").select("i", "li", "b", *score)).join(others, "b").where("i < j")
            if crossing:
                pairs = pairs.where("li <> lj")
            found = pairs.orderBy("i", "j").limit(most).collect()
            if len(found) == most or not crossing or leaders.count() < few:
                return [[r["i"], r["j"], *([r["score"]] if self.scored else [])] for r in found]
            few *= 8
