"""Language-model scoring of whole texts by prediction by partial matching.

The model is a trie of byte contexts over all training text, with escapes and
symbol exclusion (:mod:`ppm`); a document's score is the log10 probability of
its bytes, A-Z lower-cased, and of its end.  Beside it stands the score of an
add-one unigram model over words, for comparison.

Counts cover all training rows.  One pass over the text gives the byte windows
and, by 64-bit hash, the words of each task, already summed.  The most
frequent words (``hot_words`` at most) and contexts (``max_nodes`` at most) go to every
executor; all rarer words of a document, and its bytes in all rarer contexts, take a
shuffle join with tables made from the full counts, so nothing that grows with
the corpus is broadcast and nothing is left out of the model.

Defined results: null text counts as empty; an empty text is one token, its
end; without training rows every count is 0, the unigram score of a token is
log10(1) and the byte model is uniform over the 256 bytes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import ppm
from tidemark.llm.common import as_bytes, pieces, top_rows
from tidemark.runtime import materialise

WORDS = -1  # stands for a model in tables of counts


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def count_corpus(texts: DataFrame, order: int) -> DataFrame:
    """``(model, key, cnt)`` over all rows of ``texts`` (one binary column): byte windows as model 0, word hashes as model -1."""

    def run(batches):
        tally, words = ppm.Tally(order), Counter()

        def flush():
            keys = np.fromiter(map(_word_hash, words), np.int64, len(words))
            cnt = np.fromiter(words.values(), np.int64, len(words))
            for a in range(0, len(keys), 200_000):
                k = keys[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), WORDS, np.int32)), pa.array(k), pa.array(cnt[a : a + 200_000])], schema=ppm.COUNTS)
            words.clear()

        for _, texts in pieces(batches, 0):
            for text in map(bytes.lower, texts):
                tally.add(0, text)
                words.update(text.split())
                if len(words) > 200_000:
                    yield from flush()
            yield from tally.batches(final=False)
        yield from tally.batches(final=True)
        yield from flush()

    # a task's keys differ already: dealt out before they are summed, no task holds them all in a hash map as well
    return texts.mapInArrow(run, "model int, key long, cnt long").repartition("model", "key").groupBy("model", "key").agg(F.sum("cnt").alias("cnt"))


class ByteModel:
    """What every executor gets: the trie and the hot words' counts, both of bounded size."""

    def __init__(self, trie: ppm.Trie, hot: np.ndarray, counts: np.ndarray):
        self.trie, self.hot, self.logs = trie, hot, np.log10(counts + 1.0)
        self._by_hash: dict | None = None
        self._by_word: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_by_hash": None, "_by_word": {}}

    def look(self, word: bytes) -> float:
        """log10(count + 1) of a hot word, else -1."""
        if self._by_hash is None:
            self._by_hash = dict(zip(self.hot.tolist(), self.logs.tolist(), strict=True))
        if len(self._by_word) > 100_000:
            self._by_word.clear()
        found = self._by_word[word] = self._by_hash.get(_word_hash(word), -1.0)
        return found


def train(docs: DataFrame, where: Column, text: str = "text", order: int = 5, max_nodes: int = 3 << 15, hot_words: int = 250_000, max_table_bytes: int = 80 << 20):
    """The byte model, a function that gives ``(key, bits)`` of windows it leaves out, the table ``(hash, cnt)`` of all words, and the numbers of words, of distinct words and of texts."""
    rows = docs.where(where).select(as_bytes(text).alias("text"))
    counts = materialise(count_corpus(rows, order), "counts")
    windows = counts.where(F.col("model") == 0)
    trie, cold = ppm.fit_whole(windows, order, max_table_bytes, max_nodes)
    words = counts.where(F.col("model") == WORDS).select(F.col("key").alias("hash"), "cnt")
    n_words, distinct = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    hot = words.where(top_rows(words, "cnt", hot_words)).toArrow()  # about hot_words rows
    model = ByteModel(trie, hot.column(0).to_numpy().astype(np.int64), hot.column(1).to_numpy().astype(np.int64))
    return model, lambda wanted: ppm.cold_bits(windows, wanted, cold), words, n_words, distinct, rows.count()


def _by_text(left: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[pa.Array, pa.Array]:
    """For each of ``n`` texts the distinct windows of ``left`` (numbers of texts, windows) and how often each occurs."""
    text, key = (np.concatenate([x[i] for x in left] or [np.zeros(0, np.int64)]) for i in (0, 1))
    by = np.lexsort((key, text))
    text, key = text[by], key[by]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), (text[1:] != text[:-1]) | (key[1:] != key[:-1])])
    times = np.diff(np.r_[first, len(key)]).astype(np.int32)
    ends = pa.array(np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(key[first])), pa.ListArray.from_arrays(ends, pa.array(times))


def score(docs: DataFrame, where: Column, columns: list[Column], text: str = "text", **settings) -> DataFrame:
    """``columns`` of every row of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    model, cold_bits, words, n_words, distinct, n_texts = train(docs, where, text, **settings)
    tokens, kinds = n_words + n_texts, distinct + (n_texts > 0)
    below, end_log, end_known = math.log10(tokens + kinds + 1), math.log10(n_texts + 1), int(n_texts > 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model  # the driver needs it no more
    pa.default_memory_pool().release_unused()
    extra = pa.schema([("__row", pa.int64()), ("__tokens", pa.int64()), ("__known", pa.int64()), ("__base", pa.float64()), ("__bits", pa.float64()), ("__rare", pa.list_(pa.int64())), ("__times", pa.list_(pa.int32())), ("__cold", pa.list_(pa.int64())), ("__often", pa.list_(pa.int32()))])

    def run(batches):
        model = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch, texts in pieces(batches, "__text"):
            texts = [t.lower() for t in texts]
            left: list = []
            bits = model.trie.bits(texts, left)[:, 0]
            cold, often_cold = _by_text(left, len(texts))
            n, known, base, rare, times = [], [], [], [], []
            look, seen = model.look, model._by_word.get
            for t in texts:
                words = t.split()
                hot, total, hashes, often = 0, 0.0, [], []
                for w, k in Counter(words).items():
                    v = seen(w)
                    if v is None:
                        v = look(w)
                    if v >= 0:
                        hot += k
                        total += k * v
                    else:
                        hashes.append(_word_hash(w))
                        often.append(k)
                n.append(len(words) + 1)
                known.append(hot)
                base.append(total)
                rare.append(hashes)
                times.append(often)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            made = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip((rows, n, known, base, bits, rare, times, cold, often_cold), extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *extra.names])

    shape = docs.select(*columns).schema
    for name, kind in (("__row", "long"), ("__tokens", "long"), ("__known", "long"), ("__base", "double"), ("__bits", "double"), ("__rare", T.ArrayType(T.LongType())), ("__times", T.ArrayType(T.IntegerType())), ("__cold", T.ArrayType(T.LongType())), ("__often", T.ArrayType(T.IntegerType()))):
        shape = shape.add(name, kind)
    per_doc = materialise(docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, shape), "scores")
    shared.destroy()  # the table is written: nothing reads the model again

    def exploded(keys: str, times: str) -> DataFrame:
        pairs = per_doc.select("__row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("x"))
        return pairs.select("__row", F.col("x.key").alias("key"), F.col("x.times").alias("times"))

    rare = exploded("__rare", "__times").join(words.withColumnRenamed("hash", "key"), "key")
    rest = rare.groupBy("__row").agg(F.sum("times").alias("__k"), F.sum(F.col("times") * F.log10(F.col("cnt") + 1.0)).alias("__b"))
    wanted = materialise(cold_bits(exploded("__cold", "__often").select("key").distinct()), "cold")
    cold = exploded("__cold", "__often").join(wanted, "key").groupBy("__row").agg(F.sum(F.col("times") * F.col("bits")).alias("__c"))
    out = per_doc.drop("__rare", "__times", "__cold", "__often").join(rest, "__row", "left").join(cold, "__row", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.select(*columns).columns],
        F.col("__tokens").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__k", F.lit(0)) + end_known).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__b", F.lit(0.0)) + F.lit(end_log) - F.col("__tokens") * F.lit(below)).alias("base_score"),
        ((F.col("__bits") + F.coalesce("__c", F.lit(0.0))) * F.lit(-math.log10(2))).alias("score"),
    )
