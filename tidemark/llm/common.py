"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null ids fall in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def word_count(column: str) -> Column:
    """Number of words, 0 for null; an expression of built-in functions."""
    flat = F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.regexp_extract_all(flat, F.lit("[^ ]+"), F.lit(0))), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def hash_share(column: Column, share: float, seed: int) -> Column:
    """True for a fixed share of values, chosen by hash: the same rows on any run and any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


#: A table of numbers of rows is broadcast up to so many of them (some 100 MB as a hash table); beyond, it is shuffled.
MOST_BROADCAST = 1_500_000


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a written table of few and narrow columns, to be broadcast if it has at most ``most`` rows; else to be merged."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def top_rows(df: DataFrame, count: str, most: int, tie: Column | None = None, group: str | None = None, seed: int = 1) -> Column:
    """A condition that holds for exactly the ``most`` rows of ``df`` (of each ``group``) with the largest whole number ``count`` > 0, or nearly.

    Of equal counts those with the smaller ``tie`` come first (a number of few
    values); of rows equal in both, a share is taken by hash, which is what "nearly" is about.  Only
    histograms reach the driver: of logarithms, then of the counts in the one
    bar that is cut, then of ties; a sorted limit would bring ``most`` rows from every task.
    """
    tie, g = F.lit(0) if tie is None else tie, F.lit(0) if group is None else F.col(group)
    rows = df.select(g.alias("g"), F.col(count).alias("n"), tie.alias("t"))
    bar = F.floor(F.log2("n") * 16)

    def split(seen: list, key: str, room: dict, largest: bool) -> dict:
        """For each group, the value at which its room runs out, and what room is left there."""
        at, left = {}, dict(room)
        for r in sorted(seen, key=lambda r: r[key], reverse=largest):
            if r["g"] in left and r["g"] not in at:
                if r["k"] > left[r["g"]]:
                    at[r["g"]] = r[key]
                else:
                    left[r["g"]] -= r["k"]
        return {k: (v, left[k]) for k, v in at.items()}

    def among(cut: dict, column: Column) -> Column:
        """Whether a row is of a group and value that is cut."""
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in cut.items() for x in (k, v)]), F.col("g")) == column, F.lit(False))

    seen = rows.groupBy("g", bar.alias("bar")).agg(F.count("*").alias("k")).collect()
    cut = split(seen, "bar", {r["g"]: most for r in seen}, True)
    whole = F.lit(True)
    if not cut:
        return whole
    inside = rows.where(among(cut, bar))
    cut = split(inside.groupBy("g", "n").agg(F.count("*").alias("k")).collect(), "n", {k: left for k, (_, left) in cut.items()}, True)
    equal = rows.where(among(cut, F.col("n"))).groupBy("g", "t").agg(F.count("*").alias("k")).collect()
    last = split(equal, "t", {k: left for k, (_, left) in cut.items()}, False)
    total = {(r["g"], r["t"]): r["k"] for r in equal}
    for k, (n, _) in cut.items():
        t, left = last[k]
        some = hash_share(F.struct(*[F.col(c) for c in df.columns if c != count]), left / total[k, t], seed)
        whole = F.when(g == k, (F.col(count) > n) | ((F.col(count) == n) & ((tie < t) | ((tie == t) & some)))).otherwise(whole)
    return whole


def slices(texts: list[bytes], limit: int) -> Iterator[list[int]]:
    """Consecutive indices whose texts together hold at most ``limit`` bytes (or one longer text)."""
    run: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if run and held + len(t) > limit:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t)
    if run:
        yield run


def pieces(batches: Iterable[pa.RecordBatch], column: int | str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of record batches with the bytes of a text column (null: none), each of at most ``limit`` bytes or one row.

    What is made of a part is passed on before the next is read, so a task holds
    a few times ``limit``, whatever the size of Spark's batches.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < len(sizes):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(a, b - a)
            texts = part.column(column)
            if not pa.types.is_binary(texts.type):
                texts = texts.cast(pa.string()).cast(pa.binary())
            yield part, [b"" if t is None else t for t in texts.to_pylist()]
            a = b


def masked(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep, type=pa.bool_()))
