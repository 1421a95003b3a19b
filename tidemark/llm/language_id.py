"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable length of its own, frozen after
training, with escape probabilities and symbol exclusion (:mod:`ppm`).  A text
is given the language under which its exact code length is least.  Training
reads a bounded sample of labelled rows (``max_bytes`` of text a language, taken
by hash, so that the same rows are taken on every run; copies of a text count
once); prediction reads every
whole text, in one pass without a shuffle.

Every language of the labelled rows is learned, and a tree has the same room
(``max_nodes`` contexts, ``max_table_bytes``) whatever their number, so what executors hold grows with
the number of languages, by at most ``max_table_bytes`` each, and with nothing else.

Defined results: null text, and text without a letter (as ``str.isalpha`` has it), is ``und`` with score 0;
a table without labelled rows makes every text ``und``; equal code lengths go to
the language that sorts first; a null language is never learned from; repeated rows get equal results.  A very long text is
measured whole, alone in its slice.  Columns
of the input that have the names of results do no harm: only the named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ppm
from tidemark.llm.common import as_bytes, pieces, slices

UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


class LanguageModel:
    """A tree for each language, in order of their names."""

    def __init__(self, langs: list[str], tries: list[ppm.Trie]):
        self.langs, self.tries = langs, tries

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text, all languages being as likely beforehand."""
        out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.tries else []
        for run in slices([texts[i] for i in known], 8 << 20):
            own = [known[i] for i in run]
            low = [texts[i].lower() for i in own]
            bits = np.concatenate([trie.bits(low) for trie in self.tries], 1)
            best = bits.argmin(1)
            gap = np.minimum(bits - bits[np.arange(len(own)), best][:, None], 1000)
            scores[own] = 1 / np.exp2(-gap).sum(1)
            for i, b in zip(own, best, strict=True):
                out[i] = self.langs[b]
        return out, scores


def train(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", order: int = 3, max_bytes: int = 6 << 20, max_nodes: int = 1 << 14, max_table_bytes: int = 6 << 20) -> LanguageModel:
    """Learn one tree a language from the rows of ``docs`` where ``where`` holds.

    At most ``max_bytes`` of text (in expectation) is read for each language.
    """
    rows = docs.where(where).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], [])
    size = {r["lang"]: r["size"] or 0 for r in sizes}
    share = F.create_map(*[F.lit(x) for lang_ in langs for x in (lang_, min(1.0, max_bytes / max(1, size[lang_])))])
    number = F.create_map(*[F.lit(x) for i, lang_ in enumerate(langs) for x in (lang_, i)])
    chosen = F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)
    sample = rows.where(F.coalesce(chosen, F.lit(False))).select(number[F.col("lang")].alias("model"), as_bytes("text").alias("text")).distinct()
    windows = ppm.count_in_spark(sample, order)
    return LanguageModel(langs, ppm.fit(windows, len(langs), order, max_table_bytes, max_nodes))


def identify(docs: DataFrame, model: LanguageModel, columns: list[Column], text: str = "text") -> DataFrame:
    """``columns`` of every row of ``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, as_bytes(text).alias("__text"))
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch, texts in pieces(batches, "__text"):
            langs, scores = shared.value.predict(texts)
            own = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], *schema.names])

    shape = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, shape)
