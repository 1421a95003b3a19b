"""Heuristic quality rules with cutoffs whose false rejections are bounded.

Each rule rejects a document when one of its measures passes a cutoff.  Cutoffs
are chosen on labelled rows, for each stratum (band of length).  On one part of
them (``fit_share``, by hash of the id) a path is laid
out: a sequence of settings of all rules together, from none to ever
stricter ones, each the move of one cutoff that rejects most bad rows
for each good one.  The rest is the holdout: a setting is accepted as long as an exact binomial
test on the holdout's good rows shows that all its rules together reject less than ``alpha`` of
good documents; the first failure ends the path.  As the order is fixed before the holdout is
looked at, a path needs no correction along it.  Over strata the level ``delta`` is divided; a
stratum that gets to its path's end passes its level on to those that are still
on theirs (Holm's procedure, as a graph).  So with probability
1 - delta, in every stratum all rules together reject at most ``alpha`` of good
documents.  A stratum whose holdout could not show that even without a
rejected row is merged with the next longer one, the last with the one before;
which are merged depends on numbers of rows alone.

Only labelled rows are measured to train, and all of them.  Paths are laid on counts of the whole first part; counts of the holdout cover all of it, summed in
Spark; a table of (stratum, step) counts reaches the driver.

Defined results: a null text has no word; a document without a word fails the
base rule; labels of repeated ids are good only if all are, and such an id counts once
in the holdout, rejected if any of its rows is; repeated rows are judged alike; a null id has no
label; without labels, or without bad ones, only the base rule rejects.  A very long text is measured whole, alone in
its part of a batch.  Only the named columns are read, so other columns do no
harm, whatever their names; columns asked for that have the name of a measure are an error of the caller's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, few, hash_share, masked, pieces, slices
from tidemark.runtime import materialise

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Rules: measure and what it is divided by; a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
}
#: Upper ends of the bands of length, in words; a last band has the rest.
BANDS = (150, 600)
#: Cutoffs from the laxest to the strictest.
CUTOFFS = [round(x, 6) for x in np.geomspace(4.0, 0.001, 56)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_KINDS = {"word_chars": _START & ~_SPACE, "n_symbols": np.isin(np.arange(256), list(SYMBOLS)), "n_upper": np.isin(np.arange(256), list(range(65, 91))), "n_marks": np.isin(np.arange(256), list(b"!?"))}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    key, kinds = ids[:n], len(numbers)
    for k in range(1, window):  # exact: keys are renumbered before they could overflow
        if kinds * len(numbers) >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            kinds = len(seen)
        key, kinds = key * len(numbers) + ids[k : k + n], kinds * len(numbers)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(texts: list[bytes]) -> np.ndarray:
    """The :data:`MEASURES` of each whole text."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    for own in slices(texts, 1 << 20):
        data = np.frombuffer(b"\n".join(texts[i] for i in own) + b"\n", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in own])[:-1]])
        for name, kind in _KINDS.items():
            out[own, MEASURES.index(name)] = np.add.reduceat(kind[data], starts, dtype=np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        out[i, 0], out[i, 3], out[i, 4], out[i, 5] = len(words), len(lines) - len(set(lines)), repeated_words(words), len(lines)
    return out


def base_failed(m: np.ndarray) -> np.ndarray:
    return (m[:, 0] < 10) | (100 * m[:, 4] > 20 * m[:, 0])


def rates(m: np.ndarray) -> np.ndarray:
    """One column a rule."""
    at = {c: m[:, i].astype(np.float64) for i, c in enumerate(MEASURES)}
    return np.stack([at[a] / np.maximum(at[b], 1) for a, b in RULES.values()], 1)


def stratum(m: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS), m[:, 0], "right")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = log.max()
    return float(min(1.0, math.exp(top) * np.exp(log - top).sum()))


def first_rejected(m: np.ndarray) -> np.ndarray:
    """One column a rule: the number of the laxest cutoff that a row passes, len(CUTOFFS) for none."""
    return (rates(m)[:, :, None] <= np.array(CUTOFFS)).sum(2)


def _lay(left, alpha: float) -> list[tuple[int, ...]]:
    """:func:`lay_path` from ``left(setting)``: how many good and bad rows a setting leaves, each by rule and :func:`first_rejected`."""
    setting, path, lost = [-1] * len(RULES), [], 0
    while True:
        good, bad = left(setting)
        best = None
        for r in range(len(RULES)):
            n_bad, n_good = np.cumsum(bad[r, :-1]), np.cumsum(good[r, :-1])
            score = np.where(n_bad > 0, n_bad / (n_good + 0.5), 0)
            c = int(score.argmax())
            if n_bad[c] and n_good[c] <= n_bad[c] and (best is None or score[c] > best[0]):
                best = (score[c], r, c, int(n_good[c]))
        if best is None or lost + best[3] > 2 * alpha * (lost + int(good[0].sum())) + 1:
            return path
        _, r, c, n = best
        setting[r], lost = c, lost + n
        path.append(tuple(setting))


def lay_path(good: np.ndarray, bad: np.ndarray, alpha: float, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """Settings of increasing strictness: for each rule the number of its cutoff, -1 for off.

    ``good`` and ``bad`` are :func:`first_rejected` of labelled rows, ``n_good`` and ``n_bad`` how often each
    stands (once).  Each step
    moves one rule to the cutoff with most bad rows newly rejected for each
    good one (and a half); of equal ones the laxer, and the rule that comes first.  The
    path ends where no bad row is won, more good rows than bad ones would be
    lost, or over 2 alpha of the good rows are.
    """

    def counts(rows: np.ndarray, n: np.ndarray | None, setting: list[int]) -> np.ndarray:
        own = (rows > np.array(setting)).all(1)
        n = own.astype(np.float64) if n is None else n * own
        return np.stack([np.bincount(rows[:, r], n, len(CUTOFFS) + 1) for r in range(len(RULES))]).astype(np.int64)

    return _lay(lambda setting: (counts(good, n_good, setting), counts(bad, n_bad, setting)), alpha)


def lay_paths(rows: DataFrame, groups: int, alpha: float, max_held: int) -> list[list[tuple[int, ...]]]:
    """The path of each group on all of ``rows`` (g, good, first).

    Equal rows are counted.  Up to ``max_held`` different ones the driver holds them; beyond, Spark
    counts what each step leaves, with the same result.
    """
    kinds = materialise(rows.groupBy("g", "good", "first").agg(F.count("*").alias("n")), "kinds")
    if kinds.count() <= max_held:
        held = kinds.toArrow()
        g, good, n = (held.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        good, first = good.astype(bool), held.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(RULES))
        own = [((g == i) & good, (g == i) & ~good) for i in range(groups)]
        return [lay_path(first[a], first[b], alpha, n[a], n[b]) for a, b in own]

    def left(g: int):
        def count(setting: list[int]) -> np.ndarray:
            some = kinds.where(F.col("g") == g)
            for r, c in enumerate(setting):
                some = some.where(F.col("first")[r] > c)
            out = np.zeros((2, len(RULES), len(CUTOFFS) + 1), np.int64)
            for x in some.select("good", "n", F.posexplode("first").alias("r", "c")).groupBy("good", "r", "c").agg(F.sum("n").alias("n")).collect():
                out[0 if x["good"] else 1, x["r"], x["c"]] = x["n"]
            return out

        return count

    return [_lay(left(g), alpha) for g in range(groups)]


def least_rows(alpha: float, level: float) -> int:
    """How many good rows, none of them rejected, show at ``level`` that less than ``alpha`` are."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def merged(n: list[int], least: int) -> list[int]:
    """A group for each stratum, groups being runs: each has ``least`` rows at least, unless all have fewer together."""
    group, held, out = 0, 0, []
    for x in n:
        out.append(group)
        held += x
        if held >= least:
            group, held = group + 1, 0
    if held < least and group:  # the last run is short: it joins the one before
        out = [min(g, group - 1) for g in out]
    return out


def accept(n: list[int], rejected: list[list[int]], alpha: float, delta: float) -> list[int]:
    """How many steps of each stratum's path are accepted.

    ``n[s]``: good rows of the holdout; ``rejected[s][i]``: those that step i
    rejects.  ``delta`` is divided evenly; the level of a stratum that is through goes to the others.
    """
    steps, level, through = [0] * len(n), [delta / max(1, len(n))] * len(n), set()
    while True:
        for s, counts in enumerate(rejected):
            while steps[s] < len(counts) and n[s] and binomial_tail(counts[steps[s]], n[s], alpha) <= level[s]:
                steps[s] += 1
        done = [s for s in range(len(n)) if steps[s] == len(rejected[s]) and s not in through]
        rest = [s for s in range(len(n)) if s not in through and s not in done]
        through |= set(done)
        if not done or not rest:
            return steps
        for s in rest:
            level[s] += sum(level[d] for d in done) / len(rest)


class RuleModel:
    """Cutoffs (strata, rules), infinite where a rule is off."""

    def __init__(self, cutoffs: np.ndarray):
        self.cutoffs = cutoffs

    def kept(self, m: np.ndarray) -> np.ndarray:
        return ~base_failed(m) & ~(rates(m) > self.cutoffs[stratum(m)]).any(1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", alpha: float = 0.03, delta: float = 0.05, fit_share: float = 1 / 3, max_held: int = 100_000, seed: int = 29) -> RuleModel:
    """Choose cutoffs on the rows of ``docs`` that have labels and pass the base rule; only those that ``labels`` calls good bound the false rejections."""
    told = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.min(label) == 1).alias("good"))
    told = materialise(told, "told")

    def measured(batches):
        for batch, texts in pieces(batches, 2):
            m = measure(texts)
            ok = pa.array(~base_failed(m))
            made = [batch.column(0), batch.column(1), pa.array(stratum(m)), pa.array(list(first_rejected(m)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in made], names=["id", "good", "stratum", "first"])

    shape = T.StructType().add("id", told.schema["id"].dataType).add("good", "boolean").add("stratum", "long").add("first", T.ArrayType(T.LongType()))
    rows = docs.select(F.col(id_column).alias("id"), as_bytes(text).alias("text")).join(few(told), "id").select("id", "good", "text")
    seen = materialise(rows.mapInArrow(measured, shape), "labelled")
    to_fit = hash_share(F.col("id"), fit_share, seed)
    counts = [0] * (len(BANDS) + 1)
    holdout = seen.where(~to_fit & F.col("good"))
    for r in holdout.groupBy("stratum").agg(F.count_distinct("id").alias("n")).collect():
        counts[r["stratum"]] = r["n"]
    group = merged(counts, least_rows(alpha, delta / len(counts)))
    in_group = F.element_at(F.array(*map(F.lit, group)), F.col("stratum").cast("int") + 1)
    paths = lay_paths(seen.where(to_fit).select(in_group.alias("g"), "good", "first"), max(group) + 1, alpha, max_held)
    step = F.lit(None).cast("int")
    for g, path in enumerate(paths):
        for i in reversed(range(len(path))):
            passes = F.lit(False)
            for r, c in enumerate(path[i]):
                if c >= 0:
                    passes = passes | (F.col("first")[r] <= c)
            step = F.when((in_group == g) & passes, i).otherwise(step)
    by_id = holdout.select("id", in_group.alias("g"), step.alias("step")).groupBy("id", "g").agg(F.min("step").alias("step"))
    n, rejected = [0] * len(paths), [[0] * len(p) for p in paths]
    for r in by_id.groupBy("g", "step").count().collect():
        n[r["g"]] += r["count"]
        if r["step"] is not None:
            for i in range(r["step"], len(paths[r["g"]])):
                rejected[r["g"]][i] += r["count"]
    steps = accept(n, rejected, alpha, delta)
    cutoffs = np.full((len(counts), len(RULES)), np.inf)
    for s, g in enumerate(group):
        if steps[g]:
            cutoffs[s] = [CUTOFFS[c] if c >= 0 else np.inf for c in paths[g][steps[g] - 1]]
    return RuleModel(cutoffs)


def judge(docs: DataFrame, model: RuleModel, columns: list[Column], text: str = "text") -> DataFrame:
    """``columns`` of every row with its measures, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select(*columns).schema
    for name in MEASURES:
        shape = shape.add(name, "long")
    shape = shape.add("base_failed", "boolean").add("kept", "boolean")

    def run(batches):
        for batch, texts in pieces(batches, "__text"):
            m = measure(texts)
            made = [*(pa.array(m[:, i]) for i in range(len(MEASURES))), pa.array(base_failed(m)), pa.array(shared.value.kept(m))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=shape.names)

    return docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, shape)


def keep_passing(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in pieces(batches, text):
            yield masked(batch, shared.value.kept(measure(texts)))

    return docs.mapInArrow(run, docs.schema)
