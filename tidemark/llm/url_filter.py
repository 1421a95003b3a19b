"""URL filtering as a sort-merge range join with a stack of nested rules.

A host is written with its labels reversed and each ended by a dot
(``www.example.com`` becomes ``com.example.www.``), so the hosts that a rule
covers, its own and all subdomains, are one interval of keys: those that begin
with the rule's key.  Pages and rules are dealt into ranges of keys, each range
is sorted, and one sweep over it keeps the stack of the rules whose interval is
open; a page is judged by the longest rule on the stack whose path begins its
own.

Ranges are cut at quantiles of (key, page hash), so that a host that holds a
third of all pages is spread over many ranges.  A rule goes to every range that
its interval meets: that is, beside its own range, one copy for each range cut
inside the interval.  Neither pages nor rules are gathered on the driver; only
the cuts, of fixed number, are.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; a page without a rule gets the default verdict; of two
equally long rules that fit, the one with the longer host wins; of rules that
are the same text, a block wins; a rule with an empty or null host, or without a verdict, covers nothing;
one with a null path covers every path.  A null page id is carried as it is, repeated rows are
judged alike, and a url of any length is read whole; other columns of pages and rules aren't looked at.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import shuffle_partitions

END = "\U0010ffff"


def lower(c: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column, both empty where there is no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(F.col(url))))
    host = lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> Column:
    """Reversed labels, each ended by a dot; an empty host has an empty key."""
    key = F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.", -1)), "."), F.lit("."))
    return F.when(F.col(host) == "", F.lit("")).otherwise(key)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


class Sweep:
    """One pass over rows in order of (key, rules first); ``stack`` holds the hosts with rules that contain the current key.

    A host's rules are kept by path, so a page looks up beginnings of its own
    path, one for each length that a rule of the host has, however many rules there are.
    """

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, rules, lengths = self.stack[-1]
        own = (len(host) + len(path), len(host), verdict == "block", verdict, host + path)
        if path not in rules and (at := bisect.bisect_left(lengths, len(path))) == bisect.bisect_right(lengths, len(path)):
            lengths.insert(at, len(path))
        rules[path] = max(own, rules.get(path, own))

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        best = None
        for _, rules, lengths in self.stack:
            for n in reversed(lengths[: bisect.bisect_right(lengths, len(path))]):
                if (found := rules.get(path[:n])) is not None:
                    best = found if best is None else max(best, found)
                    break  # shorter paths of the same host lose
        return best and (best[4], best[3])


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``id_column, host, path, rule, verdict`` for every row of ``pages``; ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    ranges = ranges or max(1, 2 * shuffle_partitions(spark))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("__url")).select("id", *(c.alias(n) for c, n in zip(host_and_path("__url"), ("host", "path"), strict=True)))
    rows = rows.withColumn("key", host_key("host")).withColumn("tie", F.xxhash64("id", "path"))
    known = rules.where("host <> '' AND verdict IS NOT NULL").select(lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").withColumn("key", host_key("host"))
    cuts = _cuts(rows, ranges)
    shared = spark.sparkContext.broadcast(cuts)

    def number(batches):
        for batch in batches:
            at = [bisect.bisect_right(shared.value, x) for x in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spread(batches):
        for batch in batches:
            at, parts = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                lo, hi = bisect.bisect_left(shared.value, (key, -(1 << 63))), bisect.bisect_right(shared.value, (key + END, 1 << 63))
                parts += range(lo, hi + 1)
                at += [i] * (hi + 1 - lo)
            own = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *own.columns], names=["part", *own.schema.names])

    page_rows = rows.mapInArrow(number, "part int, id {}, host string, path string, key string, tie long".format(rows.schema["id"].dataType.simpleString()))
    rule_rows = known.mapInArrow(spread, "part int, host string, path string, verdict string, key string")
    both = page_rows.select("part", "key", F.lit(1).alias("kind"), "tie", "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        rule_rows.select("part", "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "host", "path", "verdict")
    )
    dealt = both.repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", "kind")  # by hash, several parts would meet in one task

    def sweep(batches):
        now, own = None, Sweep()
        for batch in batches:
            keep, found, verdicts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict"))
            for i, (part, key, kind, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    now, own = part, Sweep()
                if kind == 0:
                    own.open(key, host, path, verdict)
                    continue
                got = own.judge(key, path)
                keep.append(i)
                found.append(got and got[0])
                verdicts.append(got[1] if got else default)
            out = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([out.column("id"), out.column("host"), out.column("path"), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    shape = "id {}, host string, path string, rule string, verdict string".format(rows.schema["id"].dataType.simpleString())
    return dealt.select("part", "key", "kind", "id", "host", "path", "verdict").mapInArrow(sweep, shape).withColumnRenamed("id", id_column)


def _cuts(rows: DataFrame, ranges: int, each: int = 60) -> list[tuple[str, int]]:
    """At most ``ranges`` - 1 cuts of (key, tie), from a sample of about ``each * ranges`` rows, which holds every key in proportion.

    The cuts only say how work is dealt out, not what comes of it.
    """
    sample = rows.select("key", "tie").sample(min(1.0, each * ranges / max(1, rows.count())), 5).collect()
    found = sorted((r["key"], r["tie"]) for r in sample)
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
