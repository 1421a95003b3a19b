"""Near-duplicate embeddings through an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and the
pairs of codewords form a grid of cells (Babenko and Lempitsky, CVPR 2012).  A
vector lies in the cell of its two nearest codewords; to find its neighbours it
visits, by the multi-sequence rule, the cells nearest to it until the excess of
squared distance over its own cell passes a radius.  The radius is calibrated:
pairs at exactly the similarity threshold, apart in a random direction of the
whole space or of one half alone, must meet with the wanted recall.  A pair
meets where the vector in the lower-numbered cell visits the other's cell, so
every pair is looked at once.  In a cell all similarities are then worked out
exactly, in double precision, so no pair below the threshold is ever linked.
Codebooks are fitted on about ``sample`` vectors, or 8 a codeword where that is
more; every vector is indexed.

Equal vectors are one class with a count.  Cells with many vectors are split
into blocks of bounded size, every block of visitors meeting every block of
residents; a block gives each vector its number of links and one link towards
its block's component, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different
length never link; a null id is in no minimum; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import few, hash_share
from tidemark.operators.components import connected_components, look_up
from tidemark.runtime import materialise

BLOCK = 512  # residents of a cell in one task
VISITORS = 512  # visitors of a cell in one task
CELL = 64  # vectors of a label to a cell of the grid, so that the codebooks grow with the root of the data
INDEXED = 64  # vector lengths that get an index; vectors of other lengths share one cell a length and label, in blocks


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(half: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    centres = half[rng.choice(len(half), k, replace=len(half) < k)].copy()
    step = max(1, (1 << 24) // k)
    for _ in range(rounds):
        near = np.concatenate([_squares(half[a : a + step], centres).argmin(1) for a in range(0, len(half), step)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, half)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = half[rng.choice(len(half), int((n == 0).sum()))]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class MultiIndex:
    """Two codebooks and the calibrated radius."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius: float = 0.0):
        self.first, self.second, self.radius = first, second, radius
        self.k = len(first)

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 11) -> "MultiIndex":
        """``k`` codewords a half, at most one a vector of ``sample``; needs some 50 vectors to calibrate on."""
        rng = np.random.default_rng(seed)
        cut = sample.shape[1] // 2
        index = cls(_codebook(sample[:, :cut], k, rng), _codebook(sample[:, cut:], k, rng))
        x = sample[rng.choice(len(sample), 4000)]
        y = np.concatenate([_apart(x[:2000], threshold, rng, slice(None)), _apart(x[2000:3000], threshold, rng, slice(0, cut)), _apart(x[3000:], threshold, rng, slice(cut, None))])
        (cx, ex), (cy, ey) = index._excess(x), index._excess(y)
        x_visits = cx <= cy
        there = np.where(x_visits, cy, cx)
        e1, e2 = (np.where(x_visits[:, None], a, b) for a, b in zip(ex, ey, strict=True))
        rows = np.arange(len(x))
        index.radius = float(np.quantile(e1[rows, there // k] + e2[rows, there % k], recall)) + 1e-9
        return index

    def _excess(self, x: np.ndarray):
        cut = self.first.shape[1]
        d1, d2 = _squares(x[:, :cut], self.first), _squares(x[:, cut:], self.second)
        return d1.argmin(1) * self.k + d2.argmin(1), (d1 - d1.min(1, keepdims=True), d2 - d2.min(1, keepdims=True))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells; and (row, cell) of every visit: the home cell and all later cells within the radius, nearest first."""
        home, (e1, e2) = self._excess(x)
        rows, cells = [], []
        o1, o2 = e1.argsort(1), e2.argsort(1)
        s1, s2 = np.take_along_axis(e1, o1, 1), np.take_along_axis(e2, o2, 1)
        for r in range(len(x)):
            ends = np.searchsorted(s2[r], self.radius - s1[r, : np.searchsorted(s1[r], self.radius, "right")], "right")
            i = np.repeat(np.arange(len(ends)), ends)
            j = np.arange(len(i)) - np.repeat(np.cumsum(ends) - ends, ends)
            got = o1[r, i] * self.k + o2[r, j]
            got = got[np.argsort(s1[r, i] + s2[r, j], kind="stable")]
            got = got[got >= home[r]]
            rows.append(np.full(len(got), r))
            cells.append(got)
        return home, np.concatenate(rows), np.concatenate(cells)


def _apart(x: np.ndarray, cosine: float, rng: np.random.Generator, where: slice) -> np.ndarray:
    """Unit vectors at the given cosine from ``x``, apart in a random direction that lies mostly in the components ``where``."""
    noise = np.zeros_like(x)
    noise[:, where] = rng.standard_normal(x[:, where].shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    return cosine * x + math.sqrt(1 - cosine * cosine) * noise


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places by the links a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def meet(residents: np.ndarray, r_class: np.ndarray, r_count: np.ndarray, visitors: np.ndarray, v_class: np.ndarray, v_count: np.ndarray, at_home: np.ndarray, threshold: float):
    """Links of one block: classes, how many vectors each links with, and a class of the same component."""
    near = unit(visitors) @ unit(residents).T >= threshold
    near &= ~at_home[:, None] | (v_class[:, None] < r_class[None, :])  # in one cell each pair counts once
    v, r = np.nonzero(near)
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes, place = np.unique(np.concatenate([v_class[v], r_class[r]]), return_inverse=True)
    a, b = place[: len(v)], place[len(v) :]
    links = np.bincount(a, r_count[r], len(classes)) + np.bincount(b, v_count[v], len(classes))
    return classes, links.astype(np.int64), classes[_components(len(classes), a, b)]


def link(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.97, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label", sample: int = 16_000, seed: int = 11) -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable) and kept (it is that id)."""
    double = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.DoubleType)
    kind = np.float64 if double else np.float32
    whole = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>" if double else "array<float>").alias("e"))

    def pack(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            labels = batch.column(1).is_valid().to_pylist()
            for known, e in zip(labels, batch.column(2).to_pylist(), strict=True):
                x = np.array(e, kind) if known and e and None not in e else None
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            digests = [v and xxhash.xxh128_digest(v) for v in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(out))), batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=shape.names)
            at += len(out)

    shape = T.StructType().add("row", "long").add("id", "long").add("label", whole.schema["label"].dataType).add("v", "binary").add("digest", "binary")
    packed = whole.mapInArrow(pack, shape)
    # what names a class: the label and 128 bits of its vector
    rows = materialise(packed.withColumn("key", F.concat_ws("/", F.hex("digest"), F.col("label").cast("string"))).drop("digest"), "vectors")
    valid = rows.where("v IS NOT NULL")
    classes = valid.groupBy("label", "v", "key").agg(F.min("row").alias("class"), F.count("*").alias("times"), F.min("id").alias("low"))
    classes = materialise(classes, "classes")
    links = materialise(_meetings(classes, kind, threshold, recall, sample, seed), "meetings")
    comps = connected_components(links.where("class <> root"), "class", "root")
    counts = links.groupBy("class").agg(F.sum("n").alias("n"))
    named = classes.drop("label", "v").join(counts, "class", "left").join(comps.withColumnRenamed("node", "class"), "class", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "class")), "named")
    lows = named.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("members"))
    named = look_up(named, lows, "component", "members", named.count())
    named = materialise(named.select("key", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least"), "named")
    linked = look_up(valid.select("id", "key"), named, "key", "times", valid.count()).select("id", "n_links", "least")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias(id_column), "n_links", F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))


def _indexes(classes: DataFrame, kind, threshold: float, recall: float, sample: int, seed: int) -> dict[int, MultiIndex]:
    """An index for each vector length (in bytes) that has more than a block of vectors a label, of the INDEXED most frequent."""
    per = classes.groupBy("label", F.octet_length("v").alias("size")).count().groupBy("size").agg(F.sum("count").alias("n"), F.count("*").alias("labels"))
    frequent = [r for r in per.orderBy(F.desc("n"), "size").limit(INDEXED).collect() if r["n"] > BLOCK * r["labels"]]
    want = {r["size"]: max(1, round(math.sqrt(r["n"] / r["labels"] / CELL))) for r in frequent}
    chosen = F.lit(False)
    for r in frequent:
        chosen = chosen | ((F.octet_length("v") == r["size"]) & hash_share(F.col("class"), max(sample, 8 * want[r["size"]]) / r["n"], seed))
    some = classes.where(chosen).select("class", "v").toArrow()
    found: dict[int, list] = {}
    for c, v in sorted(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
        found.setdefault(len(v), []).append(v)
    return {size: MultiIndex.fit(_wide(unit(np.frombuffer(b"".join(v), kind).reshape(len(v), -1))), min(want[size], len(v)), threshold, recall, seed) for size, v in found.items()}


def _wide(x: np.ndarray) -> np.ndarray:
    """``x`` with two components at least, so that it has halves."""
    return x if x.shape[1] > 1 else np.concatenate([x, np.zeros_like(x)], 1)


def _meetings(classes: DataFrame, kind, threshold: float, recall: float, sample: int, seed: int) -> DataFrame:
    """``(class, n, root)``: links found in each block."""
    shared = classes.sparkSession.sparkContext.broadcast(_indexes(classes, kind, threshold, recall, sample, seed))
    label_type = classes.schema["label"].dataType
    shape = T.StructType().add("label", label_type).add("size", "integer").add("cell", "long").add("visit", "boolean").add("home", "boolean").add("class", "long").add("times", "long").add("v", "binary")

    def visits(index: MultiIndex | None, x: np.ndarray):
        if index is None:  # one cell for all
            return np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
        parts, step = [], max(1, (1 << 20) // index.k)
        for a in range(0, len(x), step):
            home, at, cells = index.visits(_wide(unit(x[a : a + step])))
            parts.append((home, at + a, cells))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                vectors = part.column(3).to_pylist()
                sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join(vectors[i] for i in rows), kind).reshape(len(rows), -1)
                    home, at, cells = visits(shared.value.get(size), x)
                    at, cells = np.concatenate([np.arange(len(x)), at]), np.concatenate([home, cells])
                    own = part.take(pa.array(rows[at]))
                    made = [pa.array(np.full(len(at), size, np.int32)), pa.array(cells), pa.array(np.arange(len(at)) >= len(x)), pa.array(home[at] == cells)]
                    yield pa.RecordBatch.from_arrays([own.column(0), *made, *own.columns[1:]], names=shape.names)

    seen = classes.select("label", "class", "times", "v").mapInArrow(visit, shape)
    cell = ["label", "size", "cell"]
    sizes = seen.groupBy(*cell).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("visit")) / BLOCK)).cast("int").alias("r_blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if("visit") / VISITORS)).cast("int").alias("v_blocks"),
        F.count_if(~F.col("visit")).alias("residents"),
    )
    sizes = materialise(sizes.where("residents > 0").drop("residents"), "cells")
    dealt = seen.join(few(sizes), cell)
    mine = F.pmod(F.xxhash64("class"), F.when(F.col("visit"), F.col("v_blocks")).otherwise(F.col("r_blocks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("visit"), F.col("r_blocks")).otherwise(F.col("v_blocks")) - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select(*cell, F.when(F.col("visit"), F.col("other")).otherwise(F.col("mine")).alias("r"), F.when(F.col("visit"), F.col("mine")).otherwise(F.col("other")).alias("w"), "visit", "home", "class", "times", "v")

    def block(table: pa.Table) -> pa.Table:
        visits = table.column("visit").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(table.num_rows, -1)
        cls, times, home = (table.column(c).to_numpy() for c in ("class", "times", "home"))
        r, w = np.flatnonzero(~visits), np.flatnonzero(visits)
        found = meet(x[r], cls[r], times[r], x[w], cls[w], times[w], home[w], threshold) if len(r) and len(w) else [np.zeros(0, np.int64)] * 3
        return pa.table({"class": found[0], "n": found[1], "root": found[2]})

    # dealt by block, not by cell: otherwise a join by cell would do for the grouping, and a crowded cell stay in one task
    blocks = [*cell, "r", "w"]
    return dealt.repartition(*blocks).groupBy(*blocks).applyInArrow(block, "class long, n long, root long")
