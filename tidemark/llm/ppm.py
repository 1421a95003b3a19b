"""Byte-context tries with PPM escapes and symbol exclusion, over NumPy arrays.

Training counts windows of ``order + 1`` bytes.  From those counts a trie of
contexts is frozen: a context of length k is kept when it was seen often enough
and the trie has room, so the tree has variable order.  For each kept context
the probability of all 256 next bytes is worked out once, with escape method D
(Howard, 1993) and with the symbols of longer contexts
excluded from shorter ones, so that the probabilities of a context add up to 1.
Scoring then is one table lookup a byte.

A model of all contexts seen twice or more needs more room than a trie has.  :func:`fit_whole`
freezes its most frequent contexts and marks where longer ones, *cold* ones, were left
out.  A byte whose context is cold isn't scored by the trie; its window is
handed out, and :func:`cold_bits` works out its code length from the table of all windows.

Every text is read as ``order`` bytes PAD, its own bytes, and END, neither of
which occurs inside UTF-8 text that matters: PAD is NUL, END is 0xFF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import top_rows
from tidemark.runtime import materialise

PAD, END = 0, 255
COLD = -(1 << 31)  # in place of a child: a context of the model that isn't in the trie
STEP = 1 << 18


def buffer(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their PAD and END bytes in one array, and where each begins."""
    pad, end = bytes([PAD]) * order, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    sizes = np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)])


def _pads(starts: np.ndarray, order: int) -> np.ndarray:
    return (starts[:-1, None] + np.arange(order)).ravel()


def count_windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of ``order`` context bytes and one symbol, packed in int64 (symbol lowest), and their counts."""
    data, starts = buffer(texts, order)
    packed = np.zeros(len(data) - order, np.int64)
    for k in range(order, -1, -1):  # in place: these arrays are what takes most memory
        packed <<= 8
        packed |= data[order - k : len(data) - k]
    real = np.ones(len(data), bool)
    real[_pads(starts, order)] = False
    return np.unique(packed[real[order:]], return_counts=True)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    by = np.argsort(keys, kind="stable")  # parts are mostly sorted: their runs are merged
    keys, cnt = keys[by], np.concatenate([c for _, c in parts])[by]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(cnt, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def shorter(counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The windows of each model cut to 0, 1, ... ``order`` context bytes, with their counts."""
    masks = [(1 << (8 * (k + 1))) - 1 for k in range(order + 1)]
    return [[merge_counts([(g & m, c)]) for g, c in counts] for m in masks]


class Trie:
    """Frozen tries of one or more models over one set of contexts.

    Bytes are renumbered by ``rank``: those seen in training, then one number
    for all others, which no context tells apart.  ``lengths[node * width + r]``
    holds the code length in bits under each model; ``child[node * width + r]``
    leads to the context that is one older byte longer, or, where that is not
    kept, to -1 - node, or to COLD where it has to be looked up elsewhere.
    Contexts that have no longer ones come last and have no row in ``child``.
    """

    def __init__(self, order: int, rank: np.ndarray, width: int, child: np.ndarray, lengths: np.ndarray):
        self.order, self.rank, self.width, self.child, self.lengths = order, rank, width, child, lengths
        self.models = lengths.shape[1]

    @classmethod
    def freeze(cls, by_length: list[list[tuple[np.ndarray, np.ndarray]]], max_nodes: int | None, min_count: int = 2, cold: list[tuple[np.ndarray, np.ndarray]] | None = None) -> "Trie":
        """``by_length[k][model]``: windows of k context bytes and a symbol, and their counts (:func:`shorter`).

        ``max_nodes`` bounds the trie whatever the corpus holds: the most
        frequent contexts of any length are kept, of equally frequent ones the
        shorter.  A context is never more frequent than the one it extends, so
        every kept context hangs below a kept one.  ``cold[k]``: kept contexts of
        k bytes, and the older bytes that lead from them to contexts that are
        left out but have to be marked.
        """
        order, counts = len(by_length) - 1, by_length[0]
        seen = np.zeros(256, bool)
        seen[PAD] = True  # it stands in contexts
        for g, _ in counts:
            seen[np.unique(g & 255)] = True
        rank = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int64)
        width = int(seen.sum()) + 1
        contexts = [merge_counts([(g >> 8, c) for g, c in per]) for per in by_length]
        sizes = [len(k) for k, _ in contexts]
        total = np.concatenate([c for _, c in contexts])
        length = np.repeat(np.arange(order + 1), sizes)
        fit = np.flatnonzero((total >= min_count) | (length == 0))
        fit = np.sort(fit[np.lexsort((length[fit], -total[fit]))[:max_nodes]])  # None: all
        offset = np.concatenate([[0], np.cumsum(sizes)])
        nodes = [contexts[k][0][fit[length[fit] == k] - offset[k]] for k in range(order + 1)]
        if not len(nodes[0]):
            nodes[0] = np.zeros(1, np.int64)
        base, parents = _tree(nodes)
        n = int(base[-1])
        links = []
        for k in range(1, order + 1):
            own = np.arange(base[k], base[k + 1])
            links.append((parents[own], rank[nodes[k] >> (8 * (k - 1))], own))
        each = [_code_lengths(_dense([per[m] for per in by_length], nodes, base, rank, width), parents, base) for m in range(len(counts))]
        lengths = np.stack(each, 2) if len(each) > 1 else each[0][:, :, None]  # one model's table isn't copied: it is what takes most memory
        del each
        marks = []
        for k, (ctx, older) in enumerate(cold or []):
            marks.append((base[k] + np.searchsorted(nodes[k], ctx), rank[older]))
        inner = np.zeros(n, bool)
        inner[0] = True
        inner[parents[1:]] = True
        for at, _ in marks:
            inner[at] = True
        order_of = np.argsort(~inner, kind="stable")  # inner contexts first
        place = np.empty(n, np.int64)
        place[order_of] = np.arange(n)
        count = int(inner.sum())
        child = np.repeat(-1 - np.arange(count, dtype=np.int32), width)
        for at, older, own in links:
            child[place[at] * width + older] = np.where(inner[own], place[own], -1 - place[own])
        for at, older in marks:
            child[place[at] * width + older] = COLD
        return cls(order, rank, width, child, lengths[order_of].reshape(n * width, len(counts)))

    def bits(self, texts: list[bytes], cold: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Code length of each whole text with its END, in bits, under each model: (texts, models).

        Bytes with a cold context are left out; to ``cold``, pairs of arrays are
        added: the number of the text and the window of each such byte.
        """
        out = np.zeros((len(texts), self.models))
        if not texts:
            return out
        data, starts = buffer(texts, self.order)
        for a in range(self.order, len(data), STEP):
            b = min(a + STEP, len(data))
            ranked = self.rank[data[a - self.order : b]]
            at = np.zeros(b - a, np.int64)
            for k in range(1, self.order + 1):
                step = self.child[np.maximum(at, 0) * self.width + ranked[self.order - k : len(ranked) - k]]
                at = np.where(at >= 0, step, at)
            out_of_trie = np.flatnonzero(at == COLD)
            at[out_of_trie] = 0
            at = np.where(at >= 0, at, -1 - at)
            got = np.take(self.lengths, at * self.width + ranked[self.order :], axis=0)
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b, "left"))
            if len(out_of_trie):
                got[out_of_trie] = 0
                place = out_of_trie + a
                whose = np.searchsorted(starts, place, "right") - 1
                real = place - starts[whose] >= self.order
                place, whose = place[real], whose[real]
                packed = np.zeros(len(place), np.int64)
                for k in range(self.order + 1):
                    packed |= data[place - k].astype(np.int64) << (8 * k)
                cold.append((whose, packed))
            for k in range(self.order):  # PAD positions carry no code
                p = starts[first:last] + k - a
                got[p[(p >= 0) & (p < b - a)]] = 0
            out[first:last] += np.add.reduceat(got, np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.float64)
        return out


def _tree(nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of each length begin, and the number of each one's parent; ``nodes[k]`` are sorted."""
    base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int64)
    parents = np.zeros(int(base[-1]), np.int64)
    for k in range(1, len(nodes)):
        parents[base[k] : base[k + 1]] = base[k - 1] + np.searchsorted(nodes[k - 1], nodes[k] & ((1 << (8 * (k - 1))) - 1))
    return base, parents


def _dense(windows: list[tuple[np.ndarray, np.ndarray]], nodes: list[np.ndarray], base: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Counts of each (context, byte number) of one model."""
    out = np.zeros((int(base[-1]), width), np.float32)
    for k, (g, c) in enumerate(windows):
        if len(g) and len(nodes[k]):
            pos = np.minimum(np.searchsorted(nodes[k], g >> 8), len(nodes[k]) - 1)
            hit = nodes[k][pos] == g >> 8
            out[base[k] + pos[hit], rank[g[hit] & 255]] = c[hit]
    return out


def _code_lengths(counts: np.ndarray, parents: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Bits for each (context, byte number), contexts in order of length.

    Escape method D: of a context seen n times with d kinds of next byte, a byte
    seen c times has probability (2c - 1) / 2n and the escape d / 2n.
    """
    n, width = counts.shape
    prob, after = np.empty((n, width), np.float32), np.empty((int(base[-2]), width), np.float32)  # the longest contexts have none below them
    for k in range(len(base) - 1):
        for lo in range(int(base[k]), int(base[k + 1]), 4096):
            own = np.arange(lo, min(lo + 4096, int(base[k + 1])))
            c = counts[own].astype(np.float64)
            seen = c > 0
            if k == 0:
                rest = np.broadcast_to(1.0 / np.maximum(256 - seen.sum(1, keepdims=True), 1), c.shape)
            else:
                up = counts[parents[own]] * ~seen  # what this context has seen is excluded there
                total, kinds = up.sum(1, keepdims=True), (up > 0).sum(1, keepdims=True)
                rest = np.where(up > 0, (2 * up - 1) / np.maximum(2 * total, 1), np.where(total > 0, kinds / np.maximum(2 * total, 1), 1.0) * after[parents[own]])
            total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            if lo < len(after):
                after[own] = rest
            prob[own] = np.where(seen, (2 * c - 1) / np.maximum(2 * total, 1), np.where(total > 0, kinds / np.maximum(2 * total, 1), 1.0) * rest)
    np.maximum(prob, 1e-30, out=prob)
    np.log2(prob, out=prob)
    return np.negative(prob, out=prob)


COUNTS = pa.schema([("model", pa.int32()), ("key", pa.int64()), ("cnt", pa.int64())])


class Tally:
    """Window counts of one task, kept merged; gives batches when it holds ``limit`` windows and at the end."""

    def __init__(self, order: int, limit: int = 3_000_000, step: int = 1 << 20):
        self.order, self.limit, self.step = order, limit, step
        self.texts: dict[int, list[bytes]] = {}
        self.held: dict[int, int] = {}
        self.parts: dict[int, list] = {}

    def add(self, model: int, text: bytes) -> None:
        self.texts.setdefault(model, []).append(text)
        self.held[model] = self.held.get(model, 0) + len(text) + self.order + 1
        if self.held[model] >= self.step:
            self._count(model)

    def _count(self, model: int) -> None:
        parts = self.parts.setdefault(model, [])
        if texts := self.texts.pop(model, None):
            parts.append(count_windows(texts, self.order))
            self.held[model] = 0
        if len(parts) > 3:
            self.parts[model] = [merge_counts(parts)]

    def batches(self, final: bool) -> Iterator[pa.RecordBatch]:
        for model in sorted({*self.texts, *self.parts}):
            if final:
                self._count(model)
            parts = self.parts.get(model, [])
            if parts and (final or sum(len(k) for k, _ in parts) > self.limit):
                keys, cnt = merge_counts(parts)
                self.parts[model] = []
                for a in range(0, len(keys), 200_000):
                    k, c = keys[a : a + 200_000], cnt[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), model, np.int32)), pa.array(k), pa.array(c)], schema=COUNTS)


def count_in_spark(texts: DataFrame, order: int) -> DataFrame:
    """``(model, key, cnt)`` of all windows of ``texts``, whose columns are model (int) and text (binary)."""

    def run(batches):
        tally = Tally(order)
        for batch in batches:
            for model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.add(model, text.lower())
            yield from tally.batches(final=False)
        yield from tally.batches(final=True)

    return texts.mapInArrow(run, "model int, key long, cnt long").groupBy("model", "key").agg(F.sum("cnt").alias("cnt"))


def _cuts(windows: DataFrame, order: int) -> DataFrame:
    """``(k, model, key, cnt)``: the windows cut to k = 0, 1, ... ``order`` context bytes."""
    cut = F.expr("key & (shiftleft(1L, 8 * (k + 1)) - 1)")
    cuts = windows.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(order + 1)])))
    return materialise(cuts.groupBy("k", "model", cut.alias("key")).agg(F.sum("cnt").alias("cnt")), "windows")


def _room(width: int, max_table_bytes: int, max_nodes: int) -> int:
    return int(max(1, min(max_nodes, max_table_bytes // (4 * width))))


def _fit(cuts: DataFrame, order: int, max_table_bytes: int, max_nodes: int) -> Trie:
    room = _room(cuts.where("k = 0").select("key").distinct().count() + 1, max_table_bytes, max_nodes)
    contexts = cuts.groupBy("k", F.expr("shiftright(key, 8)").alias("ctx")).agg(F.sum("cnt").alias("total")).where("total > 1 OR k = 0")
    # the context of no bytes is the most frequent; a parent is more frequent than its child, or as frequent and shorter
    hot = top_rows(contexts.where("k > 0"), "total", room, F.col("k")) | (F.col("k") == 0)
    kept = contexts.where(hot).select(F.col("k").alias("kk"), "ctx")  # about max_nodes rows
    rows = cuts.join(F.broadcast(kept), (F.col("k") == F.col("kk")) & (F.expr("shiftright(key, 8)") == F.col("ctx"))).select("k", "key", "cnt").toArrow()
    k, key, cnt = (rows.column(i).to_numpy() for i in range(3))
    return Trie.freeze([[_of(k, key, cnt, length)] for length in range(order + 1)], None, 1, _cold_children(contexts.where(~hot), kept, order))


def _of(k: np.ndarray, key: np.ndarray, cnt: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of one length, sorted."""
    own = np.flatnonzero(k == length)
    own = own[np.argsort(key[own], kind="stable")]
    return key[own].astype(np.int64), cnt[own].astype(np.int64)


def _cold_children(cold: DataFrame, kept: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the kept contexts with, one by one, the older bytes that lead to ``cold`` ones: at most 256 a kept context."""
    up = F.expr("ctx & (shiftleft(1L, 8 * (k - 1)) - 1)")
    below = cold.select((F.col("k") - 1).alias("k"), up.alias("up"), F.expr("shiftright(ctx, 8 * (k - 1))").cast("short").alias("older"))
    found = below.join(F.broadcast(kept), (F.col("k") == F.col("kk")) & (F.col("up") == F.col("ctx"))).groupBy("k", "up").agg(F.collect_list("older").alias("older")).toArrow()
    k, ctx, older = found.column(0).to_numpy(), found.column(1).to_numpy().astype(np.int64), found.column(2).combine_chunks()
    times = older.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    k, ctx, older = np.repeat(k, times), np.repeat(ctx, times), older.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return [(ctx[k == length], older[k == length]) for length in range(order)]


def fit(windows: DataFrame, models: int, order: int, max_table_bytes: int, max_nodes: int) -> list[Trie]:
    """A frozen trie for each model of ``(model, key, cnt)``, of its own most frequent contexts.

    Which contexts are kept is decided over all counts, in Spark; the driver
    gets the symbols of at most about ``max_nodes`` contexts a model, fewer where its table of
    code lengths would pass ``max_table_bytes``.
    """
    cuts = _cuts(windows, order)
    contexts = cuts.groupBy("model", "k", F.expr("shiftright(key, 8)").alias("ctx")).agg(F.sum("cnt").alias("total")).where("total > 1 OR k = 0")
    width = cuts.where("k = 0").select("key").distinct().count() + 1
    hot = top_rows(contexts.where("k > 0"), "total", _room(width, max_table_bytes, max_nodes), F.col("k"), "model") | (F.col("k") == 0)
    kept = contexts.where(hot).select(F.col("model").alias("mm"), F.col("k").alias("kk"), "ctx")
    same = (F.col("model") == F.col("mm")) & (F.col("k") == F.col("kk")) & (F.expr("shiftright(key, 8)") == F.col("ctx"))
    rows = cuts.join(F.broadcast(kept), same).select("model", "k", "key", "cnt").toArrow()
    model, k, key, cnt = (rows.column(i).to_numpy() for i in range(4))
    out = []
    for m in range(models):
        own = model == m
        out.append(Trie.freeze([[_of(k[own], key[own], cnt[own], length)] for length in range(order + 1)], None, 1))
    return out


class Cold:
    """What code lengths under cold contexts need beside the windows that end in the same ``head`` context bytes.

    That is the counts of all windows with fewer context bytes, at most
    256 ** 3 whatever the corpus holds.
    """

    def __init__(self, order: int, head: int, rank: np.ndarray, width: int, low: list[tuple[np.ndarray, np.ndarray]]):
        self.order, self.head, self.rank, self.width, self.low = order, head, rank, width, low

    def bits(self, keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Code lengths of the windows ``wanted``; ``keys`` are all windows of training text that share ``head`` context bytes with one."""
        masks = [(1 << (8 * (k + 1))) - 1 for k in range(self.order + 1)]
        windows = [*self.low, *(merge_counts([(keys & m, counts)]) for m in masks[self.head :])]
        nodes = []
        for k, (g, c) in enumerate(windows):
            seen, total = merge_counts([(g >> 8, c)])
            nodes.append(np.intersect1d((wanted & masks[k]) >> 8, seen[(total > 1) | (k == 0)]))
        base, parents = _tree(nodes)
        lengths = _code_lengths(_dense(windows, nodes, base, self.rank, self.width), parents, base)
        at = np.zeros(len(wanted), np.int64)
        for k in range(1, self.order + 1):
            if len(nodes[k]):
                own = (wanted & masks[k]) >> 8
                pos = np.minimum(np.searchsorted(nodes[k], own), len(nodes[k]) - 1)
                at = np.where(nodes[k][pos] == own, base[k] + pos, at)
        return lengths[at, self.rank[wanted & 255]]


def fit_whole(windows: DataFrame, order: int, max_table_bytes: int, max_nodes: int) -> tuple[Trie, Cold]:
    """One model of all contexts that ``(model, key, cnt)`` has twice or more: a trie of the most frequent, bounded as in :func:`fit`, and what the others need."""
    cuts = _cuts(windows, order)
    trie = _fit(cuts, order, max_table_bytes, max_nodes)
    head = min(3, order)
    rows = cuts.where(F.col("k") < head).select("k", "key", "cnt").orderBy("k", "key").toArrow()
    k, key, cnt = (rows.column(i).to_numpy() for i in range(3))
    return trie, Cold(order, head, trie.rank, trie.width, [(key[k == n], cnt[k == n]) for n in range(head)])


def cold_bits(windows: DataFrame, wanted: DataFrame, cold: Cold, limit: int = 16_384) -> DataFrame:
    """``(key, bits)`` for the distinct windows ``wanted`` (column key), from all of ``windows`` (key, cnt).

    Both are dealt by the last ``head`` context bytes; a task holds about ``limit``
    windows or those of one such group, at most 256 ** (order - head + 1).
    """
    shared = windows.sparkSession.sparkContext.broadcast(cold)
    group = F.expr(f"shiftright(key, 8) & {(1 << (8 * cold.head)) - 1}")

    def run(batches):
        held: list[list[np.ndarray]] = []

        def given(group, key, cnt):
            ask = cnt == 0
            if ask.any():
                near = ~ask & np.isin(group, group[ask])
                yield pa.RecordBatch.from_arrays([pa.array(key[ask]), pa.array(shared.value.bits(key[near], cnt[near], key[ask]).astype(np.float64))], names=["key", "bits"])

        for batch in batches:
            for a in range(0, batch.num_rows, limit):
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.slice(a, limit).columns])
                if sum(len(h[0]) for h in held) >= limit and held[0][0][0] != held[-1][0][-1]:
                    parts = [np.concatenate(c) for c in zip(*held, strict=True)]
                    end = int(np.searchsorted(parts[0], parts[0][-1]))
                    yield from given(*(p[:end] for p in parts))
                    held = [[p[end:] for p in parts]]
        if held:
            yield from given(*(np.concatenate(c) for c in zip(*held, strict=True)))

    rows = windows.select(group.alias("g"), "key", "cnt").unionByName(wanted.select(group.alias("g"), "key", F.lit(0).cast("long").alias("cnt")))
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "key long, bits double")
