"""Binding a table: names, types, emptiness, row positions, fingerprint.

A DataFrame has no order, but findings and splits name rows by position.  So the
table is written once with a dense position, and everything else reads that.
Columns get the internal names c0, c1, ... , which can't clash with each other,
with Spark's case-insensitive names, or with columns that the checks add.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cells
from tidemark.runtime import materialise

ROW = "__row_id"


@dataclass
class Table:
    """``df`` holds ROW and c0 ... cN; ``names`` are the user's, in order."""

    df: DataFrame
    names: list[str]
    kinds: dict[str, T.DataType]
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def __contains__(self, name: str) -> bool:
        return name in self.kinds

    def inner(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.inner(name))

    def lookup(self, name: str) -> tuple[Column, T.DataType]:
        return self.col(name), self.kinds[name]

    def missing(self, name: str) -> Column:
        return cells.missing(*self.lookup(name))

    def number(self, name: str, booleans: bool = False) -> Column:
        return cells.number(*self.lookup(name), name, booleans)

    def key(self, name: str) -> Column:
        return cells.key(*self.lookup(name))

    def require(self, names: Iterable[str]) -> None:
        absent = [n for n in dict.fromkeys(names) if n not in self]
        if absent:
            raise ValueError(f"Missing required columns: {absent}")

    def rows(self, where: Column) -> DataFrame:
        return self.df.where(where).select(ROW)

    def fingerprint(self) -> str:
        """A digest that changes with any value, with names and with row order, whatever the partitioning.

        Each row is hashed with its position; the hashes are added up as three
        numbers, which no order of partitions changes, and those are hashed.
        """
        import hashlib

        row = F.sha2(F.to_json(F.struct(ROW, *[f"c{i}" for i in range(len(self.names))]), {"ignoreNullFields": "false"}), 256)
        part = lambda at: F.sum(F.conv(F.substring(F.col("h"), at, 15), 16, 10).cast("decimal(38,0)"))
        sums = self.df.select(row.alias("h")).agg(F.count("*"), *[part(at) for at in (1, 16, 31, 46)]).first()
        return hashlib.sha256(repr((self.names, [str(x) for x in sums])).encode()).hexdigest()


FINGERPRINT_FORMAT = "SHA-256 over column names, row count and sums of per-row SHA-256 of (position, JSON values)"


def _from_pandas(spark: SparkSession, data) -> DataFrame:
    """A pandas table as a DataFrame with its order in ROW; columns of mixed types become text."""
    import pandas as pd

    data = data.reset_index(drop=True)
    fields, columns = [], []
    for i, name in enumerate(data.columns):
        s = data[name]
        values = [None if x is None or x is pd.NA or x is pd.NaT else x for x in s.tolist()]
        kinds = {type(x) for x in values if x is not None and not (isinstance(x, float) and x != x and s.dtype == object)}
        if kinds <= {bool}:
            kind = T.BooleanType() if kinds else T.StringType()
        elif kinds <= {int}:
            kind = T.LongType()
        elif kinds <= {int, float}:
            kind, values = T.DoubleType(), [None if x is None else float(x) for x in values]
        elif kinds == {pd.Timestamp}:
            kind = T.TimestampType() if getattr(s.dtype, "tz", None) is not None else T.TimestampNTZType()
            values = [None if x is None else x.to_pydatetime() for x in values]
        else:
            kind, values = T.StringType(), [None if x is None or (isinstance(x, float) and x != x) else str(x) for x in values]
        if kinds <= {bool} and not kinds:
            values = [None] * len(values)
        fields.append(T.StructField(str(i), kind))
        columns.append(values)
    rows = list(zip(range(len(data)), *columns, strict=True))
    return spark.createDataFrame(rows, T.StructType([T.StructField(ROW, T.LongType()), *fields]))


def bind(data, order_by: str | Sequence[str] | None = None, id_column: str | None = None) -> Table:
    """Check a table and number its rows 0, 1, ... .

    ``id_column`` names a dense unique numbering that the table already has;
    ``order_by`` sorts before numbering; else rows are numbered in the order of
    the source's partitions.  A pandas table keeps its order.
    """
    if hasattr(data, "iloc"):
        names = list(data.columns)
        _check_names(names)
        if not len(data):
            raise ValueError("The table has no rows.")
        raw = _from_pandas(SparkSession.builder.getOrCreate(), data)
        inner = raw.toDF(ROW, *[f"c{i}" for i in range(len(names))])
        df = materialise(inner, "table")
    elif isinstance(data, DataFrame):
        if data.columns[:1] == [ROW]:  # a source that numbers its rows
            numbered = materialise(data.toDF(ROW, *[f"c{i}" for i in range(len(data.columns) - 1)]), "table")
            return _finish(numbered, data.columns[1:])
        names = list(data.columns)
        _check_names(names)
        kinds = [f.dataType for f in data.schema.fields]
        bad = [n for n, k in zip(names, kinds, strict=True) if isinstance(k, (T.MapType, T.StructType, T.ArrayType, T.BinaryType, T.VariantType))]
        if bad:
            raise ValueError(f"Columns must hold single values; these don't: {bad}")
        inner = data.toDF(*[f"c{i}" for i in range(len(names))])
        inner = inner.select(*[F.col(c).cast("string").alias(c) if isinstance(k, T.NullType) else F.col(c) for c, k in zip(inner.columns, kinds, strict=True)])
        if id_column is not None:
            df = _with_ids(inner, names, id_column)
        else:
            if order_by is not None:
                keys = [order_by] if isinstance(order_by, str) else list(order_by)
                inner = inner.orderBy(*[f"c{names.index(k)}" for k in keys], *inner.columns)  # rows alike in the keys go by all columns
            df = number_rows(inner)
    else:
        raise ValueError("Give a DataFrame.")
    return _finish(df, names)


def _finish(df: DataFrame, names: list[str]) -> Table:
    n = df.count()
    if not n:
        raise ValueError("The table has no rows.")
    types = {name: df.schema[f"c{i}"].dataType for i, name in enumerate(names)}
    return Table(df, names, types, n)


def _check_names(names: list) -> None:
    if not names or not all(isinstance(x, str) for x in names) or len(set(names)) != len(names):
        raise ValueError("Column names must be unique strings.")


def number_rows(df: DataFrame) -> DataFrame:
    """``df`` with a dense position ROW in partition order.

    Rows are written with a number within their partition; the offsets are
    counts of partitions, as many rows as there are partitions.
    """
    spread = materialise(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    from pyspark.sql import Window as W

    counts = spread.groupBy(part.alias("__part")).count()
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = spread.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.select((F.col("__before") + within).alias(ROW), *df.columns)


def _with_ids(df: DataFrame, names: list[str], id_column: str) -> DataFrame:
    own = F.col(f"c{names.index(id_column)}").cast("long")
    out = materialise(df.select(own.alias(ROW), "*"), "table")
    n, distinct, low, high = out.agg(F.count("*"), F.count_distinct(ROW), F.min(ROW), F.max(ROW)).first()
    if n and (distinct != n or low != 0 or high != n - 1):
        raise ValueError(f"{id_column!r} must number the rows 0 to {n - 1}, each once.")
    return out
