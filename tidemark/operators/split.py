"""Holdout splits that keep related rows together.

A row's component is the smallest position it is tied to by equal keys, at any
number of removes.  Strategies label components or rows; labels stay a DataFrame.
"""

from __future__ import annotations

import math
import random
from array import array
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cells
from tidemark.operators import molecules
from tidemark.operators.components import connected_components, look_up
from tidemark.plans.config import SplitConfig
from tidemark.plans.findings import JsonResult, json_safe, metadata
from tidemark.runtime import materialise
from tidemark.sources.tables import ROW, Table, bind

TRAIN, TEST, EXCLUDED = "train", "test", "excluded"


class SplitResult(JsonResult):
    """``assignments_df`` has (row position, label); the lists of positions are collected when first read."""

    def __init__(self, assignments_df: DataFrame, diagnostics: dict, metadata: dict):
        self.assignments_df, self.diagnostics, self.metadata = assignments_df, diagnostics, metadata
        self._labels: list[str] | None = None

    def assignments(self) -> list[str]:
        """Labels in row order."""
        if self._labels is None:
            self._labels = [r[0] for r in self.assignments_df.orderBy(ROW).select("label").collect()]
        return self._labels

    def _positions(self, label: str) -> list[int]:
        return [i for i, x in enumerate(self.assignments()) if x == label]

    @property
    def train(self) -> list[int]:
        return self._positions(TRAIN)

    @property
    def test(self) -> list[int]:
        return self._positions(TEST)

    @property
    def excluded(self) -> list[int]:
        return self._positions(EXCLUDED)

    def __eq__(self, other):
        return isinstance(other, SplitResult) and self.to_dict() == other.to_dict()

    __hash__ = None

    def to_dict(self) -> dict:
        return json_safe({"train": self.train, "test": self.test, "excluded": self.excluded, "diagnostics": self.diagnostics, "metadata": self.metadata})


def row_components(rows: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """``(ROW, component)``: rows that agree in all columns of any key set belong together.

    With one key set that is one aggregation.  With more, every row is linked to
    the first row with the same key, set by set, and the links are contracted.
    """
    if not key_sets:
        return rows.select(ROW, F.col(ROW).alias("component"))
    firsts, total = [], rows.count()
    for keys in key_sets:
        keyed = rows.select(ROW, F.struct(*keys).alias("key"))  # structs are equal where nulls in them meet
        least = keyed.groupBy("key").agg(F.min(ROW).alias("component"), F.count("*").alias("n"))
        firsts.append(look_up(keyed, least, "key", "n", total).select(ROW, "component"))
    if len(firsts) == 1:
        return firsts[0]
    links = firsts[0]
    for more in firsts[1:]:
        links = links.unionByName(more)
    return connected_components(links, ROW, "component").withColumnRenamed("node", ROW)


def held_ranks(count: int, test_size: float, seed: int) -> np.ndarray:
    """Which of ``count`` components, in order of their first rows, are held out: a seeded shuffle's first share.

    The shuffle takes four bytes a component (eight from 2 ** 32 on) on the driver.
    """
    if count < 2:
        raise ValueError("A holdout needs at least two independent groups.")
    order = array("I" if count < 1 << 32 else "Q", range(count))
    random.Random(seed).shuffle(order)
    return np.sort(np.frombuffer(order, np.uint32 if order.itemsize == 4 else np.uint64)[: min(count - 1, max(1, math.ceil(count * test_size)))]).astype(np.int64)


def split(data, config: SplitConfig, *, order_by=None, id_column: str | None = None) -> SplitResult:
    """Label every row of ``data`` (a DataFrame) train, test or excluded."""
    return Splitter(bind(data, order_by, id_column), config).result()


class Splitter:
    def __init__(self, table: Table, config: SplitConfig):
        self.t, self.c = table, config
        names = [*config.columns, *config.group_columns]
        table.require(names)
        gaps = table.df.agg(*[F.max(table.missing(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
        for n, gap in zip(names, gaps, strict=True):
            if gap:
                raise ValueError(f"Column {n!r} has missing or blank values; a split needs them all.")
        self.notes: list[str] = []
        self.diagnostics: dict = {"strategy": config.strategy, "warnings": self.notes}
        if not config.group_columns:
            self.notes.append("No group columns are given, so repeats of a sample under different keys can't be told.")
        keys = [table.key(n).alias(f"g{i}") for i, n in enumerate(config.group_columns)]
        self.rows = table.df.select(ROW, *keys)
        self.group_keys = [[f"g{i}"] for i in range(len(keys))]
        self.value: Column | None = None

    def result(self) -> SplitResult:
        labels = self._at_boundary() if self.c.bounded else self._by_group()
        labels = materialise(labels, "labels")
        self._diagnose(labels)
        return SplitResult(labels.select(ROW, "label"), self.diagnostics, metadata(self.t, self.c))

    # composition, laboratory, scaffold

    def _keys(self) -> tuple[DataFrame, list[str]]:
        c, t = self.c, self.t
        if c.strategy == "scaffold":
            return self._scaffold_keys(), ["s0"]
        if c.strategy == "composition":
            self.notes.append("Compositions are compared as they stand; settle units and formulation families first.")
        keys = [f"s{i}" for i in range(len(c.columns))]
        own = t.df.select(ROW, *[t.key(n).alias(k) for n, k in zip(c.columns, keys, strict=True)])
        return self.rows.join(own, ROW) if self.group_keys else own, keys

    def _scaffold_keys(self) -> DataFrame:
        name = self.c.columns[0]
        molecules.backend_factory()
        if not isinstance(self.t.kinds[name], T.StringType):
            raise ValueError(f"SMILES at row 0 must be text; {name!r} isn't.")
        own = self.t.df.select(ROW, self.t.col(name).alias("smiles"))
        found = own.join(materialise(molecules.scaffolds(own.select("smiles")), "scaffolds"), "smiles")
        wrong = found.where("problem IS NOT NULL").orderBy(ROW).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['problem']} at row {wrong[0][ROW]} (SMILES column {name!r})")
        self.notes.append("Murcko scaffolds leave out chirality; all acyclic molecules are one group; tautomers aren't unified.")
        return self.rows.join(found.select(ROW, F.col("scaffold").alias("s0")), ROW)

    def _by_group(self) -> DataFrame:
        c = self.c
        rows, keys = self._keys()
        rows = materialise(rows, "keys")
        members = materialise(row_components(rows, [keys, *self.group_keys]), "members")
        count = members.select("component").distinct().count()
        if c.holdout_values is not None:
            labels = self._named_holdout(rows, members)
            self.diagnostics["selection"] = "laboratories by name"
        else:
            held = held_ranks(count, c.test_size, c.seed)
            # numbering components is one sorted pass over (component) alone; the ranks were drawn without the data
            from tidemark.sources.tables import number_rows

            ranked = number_rows(members.select("component").distinct().orderBy("component")).withColumnRenamed(ROW, "rank")
            chosen = self.t.spark.createDataFrame(pa.table({"rank": held}))
            test = ranked.join(chosen, "rank", "left_semi").select("component", F.lit(TEST).alias("label"))
            labels = members.join(test, "component", "left").select(ROW, "component", F.coalesce("label", F.lit(TRAIN)).alias("label"))
            self.diagnostics |= {"selection": "seeded holdout of connected groups", "requested_test_group_fraction": c.test_size, "heldout_components": len(held)}
        self.diagnostics |= {"independent_components": count, "scientific_groups": rows.select(*keys).distinct().count()}
        return labels.join(rows, ROW)

    def _named_holdout(self, rows: DataFrame, members: DataFrame) -> DataFrame:
        kind = self.t.kinds[self.c.columns[0]]
        fits = [v for v in self.c.holdout_values if isinstance(v, str) == isinstance(kind, T.StringType)]
        key = F.col("s0")
        # a number is compared as a double, so that 1.5 doesn't name 1
        inside = key.isin(fits) if isinstance(kind, T.StringType) else key.cast("double").isin([float(v) for v in fits])
        seen = {r[0] for r in rows.where(inside).select(key).distinct().collect()} if fits else set()
        unknown = [v for v in self.c.holdout_values if v not in seen or v not in fits]
        if unknown:
            raise ValueError(f"Unknown laboratory holdout values: {sorted(map(str, unknown))}")
        labels = members.join(rows.select(ROW, F.when(inside, TEST).otherwise(TRAIN).alias("label")), ROW)
        torn = labels.groupBy("component").agg((F.min("label") != F.max("label")).alias("torn")).where("torn").limit(1).count()
        if torn:
            raise ValueError("Sample groups connect held-out laboratories with training laboratories.")
        return labels

    # time, extrapolation

    def _at_boundary(self) -> DataFrame:
        c, t = self.c, self.t
        name = c.columns[0]
        if c.strategy == "time":
            value, beyond = self._time(name)
        else:
            value = t.number(name)
            beyond = value > float(c.threshold) if c.direction == "high" else value < float(c.threshold)
            if t.df.where(value.isNull()).limit(1).count():
                raise ValueError("An extrapolation split needs finite numbers in every row.")
            self.diagnostics["boundary"] = {"threshold": c.threshold, "direction": c.direction, "equality": TRAIN}
            self.notes.append("The split extrapolates in one column; it says nothing of distance in other dimensions.")
        self.value = value
        sides = materialise(t.df.select(ROW, value.alias("value"), F.when(beyond, TEST).otherwise(TRAIN).alias("label"), *[t.key(n).alias(f"g{i}") for i, n in enumerate(c.group_columns)]), "sides")
        if not self.group_keys:
            self.diagnostics["excluded_crossing_groups"] = 0
            return sides
        members = sides.join(row_components(sides, self.group_keys), ROW)
        members = materialise(members, "members")
        torn = members.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("component", F.lit(True).alias("torn"))
        number = torn.count()
        if number and c.crossing_policy == "error":
            first = [r[0] for r in members.join(torn, "component", "left_semi").orderBy("component", ROW).limit(20).select(ROW).collect()]
            raise ValueError(f"Groups cross the split boundary (rows {first}); crossing_policy='exclude' leaves such groups out whole.")
        self.diagnostics["excluded_crossing_groups"] = number
        if number:
            self.notes.append("Groups that cross the boundary were left out whole, which can bias the selection.")
        return members.join(torn, "component", "left").withColumn("label", F.when(F.col("torn"), EXCLUDED).otherwise(F.col("label"))).drop("torn")

    def _time(self, name: str) -> tuple[Column, Column]:
        t = self.t
        if isinstance(t.kinds[name], (T.NumericType, T.BooleanType)):
            raise ValueError("Numeric times are ambiguous; use ISO timestamps.")
        value = cells.instant(*t.lookup(name))
        cutoff = t.spark.range(1).select(F.unix_micros(cells.instant(F.lit(self.c.cutoff.strip()), T.StringType()))).first()[0]
        if cutoff is None or t.df.where(value.isNull()).limit(1).count():
            raise ValueError("A time split needs absolute ISO dates or timestamps in every row, and such a cutoff.")
        micros = F.unix_micros(value)
        self.diagnostics["boundary"] = {"cutoff_utc": _iso(cutoff), "train": "<= cutoff", "test": "> cutoff"}
        self.notes.append("Times without a zone count as UTC; they should say when the record could have been known.")
        return micros, micros > cutoff

    def _diagnose(self, labels: DataFrame) -> None:
        c = self.c
        per = {r["label"]: r for r in labels.groupBy("label").agg(F.count("*").alias("n"), *([F.min("value").alias("low"), F.max("value").alias("high")] if self.value is not None else [])).collect()}
        n = {x: per[x]["n"] if x in per else 0 for x in (TRAIN, TEST, EXCLUDED)}
        if not n[TRAIN] or not n[TEST]:
            raise ValueError("The split would leave train or test empty.")
        used = labels.where(F.col("label") != EXCLUDED)

        def shared(keys: list[str]) -> int:
            return used.groupBy(*keys).agg((F.min("label") != F.max("label")).alias("both")).where("both").count()

        overlaps = {name: shared([f"g{i}"]) for i, name in enumerate(c.group_columns)}
        self.diagnostics["group_overlap_counts"] = overlaps
        scientific = [k for k in labels.columns if k.startswith("s") and k[1:].isdigit()]
        if scientific:
            self.diagnostics["scientific_group_overlap"] = shared(scientific)
        if any(overlaps.values()) or self.diagnostics.get("scientific_group_overlap"):
            raise RuntimeError("A group ended up in both partitions; this is a defect of the splitter.")
        if self.value is not None:
            show = _iso if c.strategy == "time" else float
            self.diagnostics["observed_ranges"] = {x: [show(per[x]["low"]), show(per[x]["high"])] for x in (TRAIN, TEST)}
        self.diagnostics |= {"n_train": n[TRAIN], "n_test": n[TEST], "n_excluded": n[EXCLUDED], "actual_test_row_fraction": n[TEST] / (n[TRAIN] + n[TEST])}


def _iso(micros: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)).isoformat()
