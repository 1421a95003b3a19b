"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Fingerprints are split into partitions of bits.  If two fingerprints differ in
at most r bits, and thresholds t_i >= -1 over m partitions add up to r - m + 1,
then in some partition they differ in at most t_i bits (Qin et al., "GPH:
Similarity Search in Hamming Space", ICDE 2018).  Correlated bits are grouped in
one partition, and each fingerprint gets thresholds of its own, by dynamic
programming on the candidates that histograms of all fingerprints lead it to
expect.  It then probes an index of partition values; the join verifies the
whole distance.  No link is missed, whatever the thresholds, and no candidate
is capped.

Work runs on distinct fingerprints, so that a group of exact copies is one row;
the rows of documents are joined back at the end.

Defined results: text that is null or has no word has fingerprint 0 and links
like any other; fewer than ``size`` words are one shingle; a component is named
by its smallest non-null doc_id (null if it has none); an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, few, free_name, pieces
from tidemark.operators.components import connected_components, look_up
from tidemark.runtime import materialise

BITS = 64
TABLE_BITS = 16  # histograms look at so many bits of a partition
CHUNK = 1 << 16
PROBES = 1 << 16  # in one batch


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: a bit is set where over half of the shingles' XXH64 have it set."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(size, len(words))
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends[k - 1 :] - 1).tolist()
    first = [0, *ends[: len(last) - 1].tolist()]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(last), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], np.uint64)
        lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # 255 ones fit in a byte
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, columns: list[Column], name: str, text: str = "text", size: int = 3) -> DataFrame:
    """``columns`` of every row with the fingerprint (a signed long) as ``name``."""

    def run(batches):
        for batch, texts in pieces(batches, "__text"):
            found = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], name])

    return docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, docs.select(*columns).schema.add(name, "long"))


def _numbered(docs: DataFrame, fp: str, row: str, text: str) -> DataFrame:
    """``docs`` with the fingerprint of each row as ``fp`` and a unique number as ``row``, which holds once it is written."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch, texts in pieces(batches, text):
            found = np.fromiter(map(fingerprint, texts), np.uint64, batch.num_rows)
            rows = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64)), pa.array(rows)], names=[*batch.schema.names, fp, row])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(row, T.LongType())]))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _project(values: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits at ``places`` as a number, the first place lowest."""
    out = np.zeros(len(values), np.int64)
    for i, p in enumerate(places):
        out |= ((values >> np.int64(p)) & 1) << i
    return out


def _summed(df: DataFrame, fn) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of what isn't 0 in the sum of ``fn(values)``, an array of fixed length, over all tasks."""

    def run(batches):
        total = None
        for batch in batches:
            got = fn(batch.column(0).to_numpy(zero_copy_only=False))
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "cnt"])

    rows = df.mapInArrow(run, "at long, cnt long").groupBy("at").agg(F.sum("cnt")).toArrow()
    return rows.column(0).to_numpy(), rows.column(1).to_numpy()


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Split the bits into ``m`` partitions, correlated bits together.

    ``together[i, j]``: in how many of ``n`` fingerprints both bits are set.
    """
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for part in range(m):
        width = (BITS - sum(map(len, out))) // (m - part)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in free if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        # the least predictable bits lead, as the histograms see those
        out.append(sorted(own, key=lambda b: (abs(mean[b] - 0.5), b)))
        free = [b for b in free if b not in own]
    return out


def partition_count(n: int, radius: int) -> int:
    """The number of partitions with the least probes and candidates, were bits even and independent."""

    def cost(m: int) -> float:
        width, extra = BITS / m, radius - m + 1
        probes = m - 1 + sum(_choose(width, k) for k in range(extra + 1))
        return 4 * (m + probes) + probes * n / 2.0**width

    return min(range(2, radius + 2), key=cost)


def _choose(n: float, k: int) -> float:
    out = 1.0
    for i in range(k):
        out *= (n - i) / (i + 1)
    return out


@lru_cache(maxsize=64)
def ball(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``radius`` bits set."""
    out = [0]
    for k in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(width), k)]
    return np.array(out, np.int64)


class Plan:
    """Partitions of bits and, for each, how many fingerprints lie within each distance of a value."""

    def __init__(self, places: list[list[int]], counts: list[np.ndarray], radius: int, probe_cost: float = 4.0):
        self.places, self.radius = places, radius
        self.tables = []
        self.cost = probe_cost
        for own, hist in zip(places, counts, strict=True):
            head = min(len(own), TABLE_BITS)
            rest = len(own) - head
            rings = [np.zeros(1 << head) for _ in range(radius + 1)]
            for k in range(min(radius, head) + 1):
                for mask in ball(head, k)[sum(int(_choose(head, j)) for j in range(k)) :]:
                    rings[k] += hist[np.arange(1 << head) ^ mask]
            within = []
            for t in range(radius + 1):
                est = sum(rings[a] * sum(_choose(rest, b) for b in range(t - a + 1)) for a in range(t + 1)) / 2.0**rest
                within.append((est + probe_cost * sum(_choose(len(own), j) for j in range(t + 1))).astype(np.float32))
            self.tables.append(np.stack(within))

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each fingerprint (its partition values given) the cheapest thresholds, -1 for partitions left out.

        Dynamic programming over partitions: with m of them, r + 1 units are
        dealt out, a partition with t + 1 units getting threshold t.
        """
        units, n = self.radius + 1, len(values[0])
        best = np.full((units + 1, n), np.inf, np.float32)
        best[0] = 0
        back = []
        for own, table, v in zip(self.places, self.tables, values, strict=True):
            head = v & ((1 << min(len(own), TABLE_BITS)) - 1)
            new, took = best.copy(), np.zeros((units + 1, n), np.int8)
            for t in range(units):
                cost = table[t][head]
                for s in range(t + 1, units + 1):
                    with_t = best[s - t - 1] + cost
                    less = with_t < new[s]
                    new[s][less] = with_t[less]
                    took[s][less] = t + 1
            best = new
            back.append(took)
        left, out = np.full(n, units), np.empty((n, len(self.places)), np.int8)
        for i in range(len(self.places) - 1, -1, -1):
            out[:, i] = back[i][left, np.arange(n)]
            left = left - out[:, i]
        return out - 1

    def index(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, own in enumerate(self.places):
            yield (np.int64(i) << 32) | _project(fps, own), fps

    def probes(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Signatures to look up and the fingerprints they are for, at most PROBES (or one fingerprint's of one partition) at a time."""
        for a in range(0, len(fps), 4096):
            some = fps[a : a + 4096]
            values = [_project(some, own) for own in self.places]
            limits = self.thresholds(values)
            for i, (own, v) in enumerate(zip(self.places, values, strict=True)):
                for t in range(self.radius + 1):
                    at, masks = np.flatnonzero(limits[:, i] == t), ball(len(own), t)
                    step = max(1, PROBES // len(masks))
                    for b in range(0, len(at), step):
                        part = at[b : b + step]
                        yield ((np.int64(i) << 32) | (v[part, None] ^ masks)).ravel(), np.repeat(some[part], len(masks))


def plan(fps: DataFrame, n: int, radius: int) -> Plan:
    """Statistics over all rows of ``fps`` (one long column of distinct fingerprints); 64 x 64 counts and m histograms reach the driver."""

    def pairs(values):
        b = _bits(values).astype(np.float32)
        return (b.T @ b).astype(np.int64).ravel()

    together = np.zeros(BITS * BITS)
    at, cnt = _summed(fps, pairs)
    together[at] = cnt
    places = group_bits(together.reshape(BITS, BITS), n, partition_count(n, radius))

    def histograms(values):
        return np.concatenate([np.bincount(_project(values, own[:TABLE_BITS]), minlength=1 << min(len(own), TABLE_BITS)) for own in places])

    sizes = [1 << min(len(own), TABLE_BITS) for own in places]
    flat = np.zeros(sum(sizes))
    at, cnt = _summed(fps, histograms)
    flat[at] = cnt
    return Plan(places, np.split(flat, np.cumsum(sizes)[:-1]), radius)


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the distinct fingerprints in ``fps`` (one long column) that differ in at most ``radius`` bits."""
    n = fps.count()
    made = plan(fps, n, radius)
    shared = fps.sparkSession.sparkContext.broadcast(made)

    def rows(which):
        def run(batches):
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False)
                for sigs, own in getattr(shared.value, which)(values):
                    yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(own)], names=["sig", "fp"])

        return run

    probes = fps.mapInArrow(rows("probes"), "sig long, fp long").withColumnRenamed("fp", "a")
    index = fps.mapInArrow(rows("index"), "sig long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.hint("merge").join(index, "sig").where(near).select("a", "b")


def _groups(slim: DataFrame, radius: int, least: Column) -> DataFrame:
    """``(fp, component, least, n)`` for every distinct ``fp`` of ``slim``, on n rows; ``least`` is aggregated over the component."""
    distinct = materialise(slim.groupBy("fp").agg(least.alias("low"), F.count("*").alias("n")), "fingerprints")
    comps = connected_components(near_links(distinct.select("fp"), radius), "a", "b")
    named = materialise(distinct.join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("comp"), "low", "n"), "named")
    lows = named.groupBy("comp").agg(F.min("low").alias("least"), F.count("*").alias("members"))
    return look_up(named, lows, "comp", "members", named.count()).select("fp", "comp", "least", "n")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row a document: its id, fingerprint (16 hex digits) and component_id (the component's smallest id)."""
    slim = materialise(fingerprints(docs, [F.col(id_column).alias("id")], "fp", text), "simhash")
    groups = materialise(_groups(slim, radius, F.min("id")), "groups")
    return look_up(slim, groups, "fp", "n", slim.count()).select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component left: the one with the smallest id, of equal ids any one.

    Rows are numbered when they are written with their fingerprints, so that
    rows with equal ids, or none, stay apart.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    kept = materialise(_numbered(docs, fp, row, text), "numbered")
    key = F.struct(F.col(id_column).isNull(), F.col(id_column), F.col(row).alias("row"))
    slim = kept.select(F.col(fp).alias("fp"), key.alias("key"))
    groups = _groups(slim, radius, F.min("key"))
    chosen = groups.select(F.col("least.row").alias(row)).distinct()
    gone = materialise(kept.select(row).join(chosen, row, "left_anti"), "gone")
    return kept.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
