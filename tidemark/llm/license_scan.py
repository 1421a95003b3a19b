"""Licence notices in documents, by a trained paragraph classifier.

A paragraph is a run of lines up to a blank one, or to a line that ends a sentence, so a
notice that is wrapped over lines is seen whole.  In it, passages are looked at: words
that mark licences (learned: those far more frequent in templates than in the
corpus, where it doesn't speak of licences), with what stands between and beside them.  A passage's features are its word 1- to 3-grams, as a
sparse vector; a logistic regression gives each licence family, "unknown" (licence wording
of no known family) and "none" a probability.

It is trained here, on templates with words dropped, cut and set among other words,
against generic licence wording, decoys and paragraphs of the corpus.  What it makes of wordings and
licences that it has not seen is measured by leaving out, in turn, part of the
templates of each family, and a part of the families altogether: the temperature that calibrates
probabilities and the threshold below which a prediction isn't trusted come from those.
A prediction is confirmed if the passage shares enough of the 3-grams that are peculiar to
one of the family's templates.  A family is named if it is confirmed, or if its
probability reaches the threshold, which at most ``SLIP`` of left-out families do; else the passage is
``unknown``, as is one whose probability of being licence wording at all is as high as in ``SLIP`` of the left-out decoys.

A document without a mark is passed over; for every other the whole text is scanned, in one pass without a
shuffle.  The model's size is fixed by the templates; marks are learned from counts over all texts, and about
``max_paragraphs`` documents chosen by hash give a stretch of words each, from anywhere, and one around a word that templates
have, to train on.

Defined results: null and empty texts have no paragraph and no licence; of
equally probable families the first by name wins; repeated paragraphs count
each time, and repeated rows get equal results; a text of any length is scanned whole, its memory being a few times its own
size; without a corpus to learn from, all words of templates are marks.  Only the named columns are read; columns asked for
must not have the names of results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, hash_share, pieces
from tidemark.llm.licences import DECOYS, GENERIC, TEMPLATES

NONE, UNKNOWN = "none", "unknown"
TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s*$")
GAP, BESIDE = 12, 3  # words between the marks of one passage; words taken on either side
SHARED = 0.4  # part of a template's own 3-grams that confirms a prediction
WORDING = {w for ts in [*TEMPLATES.values(), GENERIC] for t in ts for w in TOKEN.findall(t.lower()) if len(w) > 3}
# Beginnings of words, and short names, that stand for licences.
TELLING = ("licen", "sublicen", "unlicen", "copyright", "copyleft", "spdx", "warrant", "redistribut", "creativecommons", "reserved", "proprietary", "unencumbered", "hereby", "merchantab", "noninfring", "agpl", "cc0", "gpl", "lgpl")
ABBREVIATIONS = {"agpl", "bsd", "bsl", "cc", "cc0", "epl", "gnu", "gpl", "isc", "lgpl", "mit", "mpl"}
# Words of English that stand in licences as in any text.
SMALL = {"also", "either", "from", "have", "into", "must", "only", "other", "shall", "should", "some", "than", "that", "their", "there", "these", "they", "this", "were", "which", "will", "with", "would", "your"}
SLIP = 0.05  # part of the passages of licences never seen that may be named
PLAIN = 60  # words of a corpus paragraph to learn from
FOLDS = 4


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def paragraphs(text: str) -> list[tuple[list[str], list[int]]]:
    """The words of each paragraph, and the line that each word is on."""
    out, words, at = [], [], []
    for i, line in enumerate(text.split("\n")):
        own = tokens(line)
        words += own
        at += [i] * len(own)
        if words and (not line.strip() or SENTENCE_END.search(line)):
            out.append((words, at))
            words, at = [], []
    return [*out, (words, at)] if words else out


def passages(words: list[str], marks: set[str]) -> list[tuple[int, int]]:
    """Spans of words around marks that are at most GAP words apart."""
    out: list[tuple[int, int]] = []
    last = None
    for i, w in enumerate(words):
        if w in marks:
            if last is not None and i - last <= GAP:
                out[-1] = (out[-1][0], min(len(words), i + 1 + BESIDE))
            else:
                out.append((max(0, i - BESIDE), min(len(words), i + 1 + BESIDE)))
            last = i
    return out


def grams(words: list[str], longest: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def peculiar(templates: dict[str, list[str]]) -> dict[str, list[set]]:
    """For each family, the 3-grams of its templates and of each of their sentences that no other family has; all, where that leaves none."""
    own = {f: [trigrams(tokens(x)) for t in ts for x in dict.fromkeys([t, *re.split(r"(?<=[.!?])\s+", t)])] for f, ts in templates.items()}
    whose: dict[tuple, set] = {}
    for f, ts in own.items():
        for g in set().union(*ts):
            whose.setdefault(g, set()).add(f)
    return {f: [{g for g in t if len(whose[g]) == 1} or t for t in ts if t] for f, ts in own.items()}


class Sparse:
    """Rows of sorted column numbers; each row's values are equal and its length is 1."""

    def __init__(self, rows: list[list[int]]):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.columns = np.fromiter((c for r in rows for c in r), np.int64, int(self.at[-1]))
        self.value = 1 / np.sqrt(np.maximum(self.sizes, 1))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The product with a dense matrix."""
        out = np.zeros((len(self.sizes), weights.shape[1]))
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[full] = np.add.reduceat(weights[self.columns], self.at[full], axis=0) * self.value[full, None]
        return out

    def back(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transposed product with ``g``: the columns that occur, and their rows of it."""
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        found, first = np.unique(self.columns[order], return_index=True)
        return found, np.add.reduceat((g * self.value[:, None])[row], first, axis=0) if len(found) else np.zeros((0, g.shape[1]))


class Regression:
    """Multinomial logistic regression over sparse n-grams."""

    def __init__(self, classes: list[str], vocabulary: dict[str, int]):
        self.classes, self.vocabulary = classes, vocabulary
        self.weights, self.bias = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))

    def columns(self, words: list[str]) -> list[int]:
        return sorted(self.vocabulary[g] for g in grams(words) if g in self.vocabulary)

    def logits(self, x: Sparse) -> np.ndarray:
        return x.times(self.weights) + self.bias

    def of(self, passages_: list[list[str]]) -> np.ndarray:
        return self.logits(Sparse([self.columns(words) for words in passages_]))

    def fit(self, rows: list[list[str]], y: np.ndarray, rng: np.random.Generator, epochs: int = 16, size: int = 128, rate: float = 0.6, decay: float = 1e-4) -> "Regression":
        """By mini-batches; a weight's rate falls with the squares of its gradients so far."""
        known = [self.columns(words) for words in rows]
        seen, seen_bias = np.full_like(self.weights, 1e-4), np.full_like(self.bias, 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), size):
                own = order[a : a + size]
                x = Sparse([known[i] for i in own])
                g = softmax(self.logits(x))
                g[np.arange(len(own)), y[own]] -= 1
                g /= len(own)
                columns, grad = x.back(g)
                grad += decay * self.weights[columns]
                seen[columns] += grad * grad
                self.weights[columns] -= rate * grad / np.sqrt(seen[columns])
                bias = g.sum(0)
                seen_bias += bias * bias
                self.bias -= 0.1 * rate * bias / np.sqrt(seen_bias)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class LicenceModel:
    """A fitted regression with its calibration, and the templates it is checked against."""

    def __init__(self, net: Regression, templates: dict[str, list[str]], marks: set[str], temperature: float = 1.0, threshold: float = 1.0, wording: float = 0.5):
        self.net, self.marks, self.temperature, self.threshold, self.wording = net, marks, temperature, threshold, wording
        self.families, self.templates = net.classes, peculiar(templates)

    def probabilities(self, passages_: list[list[str]]) -> np.ndarray:
        return softmax(self.net.of(passages_) / self.temperature)

    def confirmed(self, family: str, words: list[str]) -> bool:
        own = trigrams(words)
        return any(len(own & t) >= max(SHARED * len(t), min(2, len(t))) for t in self.templates.get(family, []))

    def verdict(self, words: list[str], p: np.ndarray) -> tuple[str, float, bool]:
        """Family, unknown or none, with its probability, and whether a template confirms it."""
        best = int(p.argmax())
        family = self.families[best]
        if family == NONE and 1 - p[best] >= self.wording:
            return UNKNOWN, float(1 - p[best]), False
        if family in (NONE, UNKNOWN):
            return family, float(p[best]), False
        sure = self.confirmed(family, words)
        return (family if sure or p[best] >= self.threshold else UNKNOWN), float(p[best]), sure

    def scan(self, text: str) -> list[tuple[int, str, float, bool]]:
        """(line of the first mark, family or unknown, probability, confirmed) of each passage that isn't "none"."""
        if self.marks.isdisjoint(TOKEN.findall(text.lower())):
            return []
        found, lines = [], []
        for words, at in paragraphs(text):
            if self.marks.isdisjoint(words):
                continue
            for a, b in passages(words, self.marks):
                found.append(words[a:b])
                lines.append(at[next(i for i in range(a, b) if words[i] in self.marks)])
        if not found:
            return []
        told = [self.verdict(words, p) for words, p in zip(found, self.probabilities(found), strict=True)]
        return [(line, *t) for line, t in zip(lines, told, strict=True) if t[0] != NONE]


def variants(template: str, rng: np.random.Generator, filler: list[str], n: int) -> list[list[str]]:
    """The template itself and ``n`` - 1 of its words with some dropped, cut to a part, or set among others."""
    words = tokens(template)
    out = [words]
    for _ in range(n - 1):
        own = words
        if len(own) > 12 and rng.random() < 0.5:
            size = int(rng.integers(len(own) // 2, len(own) + 1))
            at = int(rng.integers(0, len(own) - size + 1))
            own = own[at : at + size]
        if len(own) > 8:
            own = [w for w in own if rng.random() > 0.06]
        pad = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 2 * BESIDE + 2))]
        cut = int(rng.integers(0, len(pad) + 1))
        out.append(pad[:cut] + own + pad[cut:])
    return out


def _fit(templates: dict[str, list[str]], generic: list[str], decoys: list[str], plain: list[list[str]], filler: list[str], classes: list[str], vocabulary: dict[str, int], seed: int, times: int = 10) -> Regression:
    rng = np.random.default_rng(seed)
    rows, y = [], []
    for k, f in enumerate(classes):
        for t in templates.get(f, generic if f == UNKNOWN else decoys):
            made = variants(t, rng, filler, times)
            rows += made
            y += [k] * len(made)
    rows += plain
    y += [classes.index(NONE)] * len(plain)
    return Regression(classes, vocabulary).fit(rows, np.array(y), rng)


def _left_out(k: int) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[str, list[str]]]:
    """Fold ``k``: templates to learn, those left out of families that are learned, and those of families that aren't."""
    learned, unseen_wordings, unseen = {}, {}, {}
    for i, f in enumerate(sorted(TEMPLATES)):
        if i % FOLDS == k:
            unseen[f] = TEMPLATES[f]
        else:
            learned[f] = [t for j, t in enumerate(TEMPLATES[f]) if j % FOLDS != k]
            unseen_wordings[f] = [t for j, t in enumerate(TEMPLATES[f]) if j % FOLDS == k]
    return learned, unseen_wordings, unseen


def calibrate(plain: list[list[str]], filler: list[str], marks: set[str], vocabulary: dict[str, int], seed: int) -> tuple[float, float, float]:
    """Temperature, threshold, and from what probability of licence wording on a passage is one, from passages of templates, families, generic wording and decoys that each fold's model hasn't learned."""
    rng = np.random.default_rng(seed)
    tried: list[tuple[LicenceModel, list[list[str]], np.ndarray, np.ndarray]] = []
    for k in range(FOLDS):
        learned, wordings, unseen = _left_out(k)
        classes = [*sorted(learned), UNKNOWN, NONE]
        rest = lambda texts, k=k: [t for j, t in enumerate(texts) if j % FOLDS != k]
        net = _fit(learned, rest(GENERIC), rest(DECOYS), plain[::2], filler, classes, vocabulary, seed + k)
        told = [(t, f) for f, ts in wordings.items() for t in ts]
        told += [(t, UNKNOWN) for ts in unseen.values() for t in ts] + [(t, UNKNOWN) for j, t in enumerate(GENERIC) if j % FOLDS == k]
        told += [(t, NONE) for j, t in enumerate(DECOYS) if j % FOLDS == k]
        rows = [(v, f) for t, f in told for v in variants(t, rng, filler, 4)] + [(p, NONE) for p in plain[1::2][k::FOLDS]]
        words = [v for v, _ in rows]
        model = LicenceModel(net, learned, marks)
        tried.append((model, words, net.of(words), np.array([classes.index(f) for _, f in rows])))

    def surprise(t: float) -> float:
        return float(np.mean(np.concatenate([-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-9)) for _, _, z, y in tried])))

    temperature = float(min(np.geomspace(0.25, 16, 61), key=surprise))
    unsure = []  # probabilities of unconfirmed families given to licences that have none here
    wording = []  # probabilities of licence wording where there is none but the words of it
    for model, words, z, y in tried:
        unknown, none = model.families.index(UNKNOWN), model.families.index(NONE)
        for w, p, truth in zip(words, softmax(z / temperature), y, strict=True):
            if truth == unknown:
                family = model.families[int(p.argmax())]
                unsure.append(float(p.max()) if family not in (NONE, UNKNOWN) and not model.confirmed(family, w) else 0.0)
            elif truth == none and not marks.isdisjoint(w):
                wording.append(float(1 - p[none]))
    threshold = float(np.quantile(unsure, 1 - SLIP, method="higher")) + 1e-9
    return temperature, max(0.5, threshold), float(np.quantile(wording, 1 - SLIP, method="higher")) if wording else 0.5


def stretches(text: bytes, seed: int) -> list[list[str]]:
    """PLAIN words from a place chosen by hash, and as many around one of the longer words of templates, if there is any, also chosen by hash."""
    words = tokens(text.decode("utf-8", "replace"))
    pick = xxhash.xxh64_intdigest(text, seed)
    at = pick % max(1, len(words) - PLAIN // 2)
    near = [i for i, w in enumerate(words) if w in WORDING]
    mid = near[pick % len(near)] if near else 0
    return [words[at : at + PLAIN], words[max(0, mid - PLAIN // 2) : mid + PLAIN // 2] if near else []]


def _plain(docs: DataFrame, text: str, most: int, seed: int) -> tuple[list[list[str]], list[list[str]]]:
    """The :func:`stretches` of about ``most`` documents chosen by hash, equal ones once."""
    known = docs.where(F.col(text).isNotNull())

    def stretch(batches):
        for _, texts in pieces(batches, 0):
            found = [(kind, " ".join(words)) for t in texts for kind, words in enumerate(stretches(t, seed)) if words]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())], names=["kind", "words"])

    chosen = known.where(hash_share(F.col(text), most / max(1, known.count()), seed)).select(as_bytes(text).alias("t"))
    rows = sorted(chosen.mapInArrow(stretch, "kind int, words string").distinct().collect())
    return tuple([r["words"].split(" ") for r in rows if r["kind"] == k] for k in (0, 1))


def tells(words: list[str]) -> bool:
    """Whether there is a word that hardly stands outside of licences and talk about them."""
    return any(w.startswith(TELLING) for w in words)


def count_stretches(texts: Iterable[bytes], wanted: set[str]) -> tuple[int, Counter]:
    """How many stretches of PLAIN words without a telling word the texts hold, and for each word of ``wanted``, in how many of these it is.

    The time a stretch takes doesn't depend on how many different words came before it.
    """
    n, found = 0, Counter()
    seen, telling = set(), set()  # words looked at, and those of them that tell
    for t in texts:
        words = tokens(t.decode("utf-8", "replace"))
        for a in range(0, len(words), PLAIN):
            own = set(words[a : a + PLAIN])
            new = own - seen
            seen |= new
            telling.update(w for w in new if w.startswith(TELLING))
            if telling.isdisjoint(own):
                n += 1
                found.update(own & wanted)
            if len(seen) > 200_000:
                seen, telling = set(), set()
    return n, found


def count_prose(docs: DataFrame, text: str) -> tuple[int, Counter]:
    """:func:`count_stretches` of all texts together, for the words of templates."""
    wanted = {w for ts in [*TEMPLATES.values(), GENERIC] for t in ts for w in tokens(t)}

    def count(batches):
        n, found = count_stretches((t for _, texts in pieces(batches, 0) for t in texts), wanted)
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(as_bytes(text).alias("t")).mapInArrow(count, "word string, n long")
    seen = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return seen.pop(None, 0), Counter(seen)


def learn_marks(n: int, corpus: Counter, times: float = 8.0) -> set[str]:
    """Words of templates that are at least ``times`` as frequent there as in the corpus's stretches without a telling word (:func:`count_prose`)."""
    templates = [set(tokens(t)) for ts in [*TEMPLATES.values(), GENERIC] for t in ts]
    rate = {w: k / len(templates) for w, k in Counter(w for t in templates for w in t).items()}
    found = {w for w in rate if len(w) > 1 and w not in SMALL and rate[w] >= times * corpus[w] / max(1, n)}
    return {w for w in found if len(w) > 3 or any(c.isdigit() for c in w) or w in ABBREVIATIONS}


def train(docs: DataFrame, text: str = "text", max_paragraphs: int = 2000, seed: int = 3) -> LicenceModel:
    """Train on the templates, generic wording and decoys, and on stretches of about ``max_paragraphs`` documents as "none"."""
    plain, near = _plain(docs, text, max_paragraphs, seed)
    marks = learn_marks(*count_prose(docs, text))
    plain, near = ([p for p in ps if not tells(p)] for ps in (plain, near))  # what may be a licence isn't learned as none
    near = [p[a:b] for p in near for a, b in passages(p, marks)]  # as they come when scanning
    plain = [*plain, *near] or [["nothing"]]
    filler = sorted({w for p in plain for w in p})
    texts = [t for ts in [*TEMPLATES.values(), GENERIC, DECOYS] for t in ts]
    vocabulary = {g: i for i, g in enumerate(sorted({g for t in texts for g in grams(tokens(t))}))}
    calibrated = calibrate(plain, filler, marks, vocabulary, seed)
    net = _fit(TEMPLATES, GENERIC, DECOYS, plain, filler, [*sorted(TEMPLATES), UNKNOWN, NONE], vocabulary, seed)
    return LicenceModel(net, TEMPLATES, marks, *calibrated)


def scan(docs: DataFrame, model: LicenceModel, columns: list[Column], text: str = "text") -> DataFrame:
    """``columns`` of every row with the number of licence passages, the most probable family (confirmed ones first, then named ones;
    null without any), its probability, whether a template confirms it, and all passages found (line, family, probability, confirmed)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = T.StructType().add("line", "integer").add("family", "string").add("probability", "double").add("confirmed", "boolean")
    shape = docs.select(*columns).schema.add("n_paragraphs", "long").add("license", "string").add("score", "double").add("confirmed", "boolean").add("paragraphs", T.ArrayType(part))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        for batch, texts in pieces(batches, "__text"):
            all_found = [shared.value.scan(t.decode("utf-8", "replace")) for t in texts]
            best = [min(f, key=lambda x: (not x[3], x[1] == UNKNOWN, -x[2], x[1])) if f else None for f in all_found]
            made = [pa.array([len(f) for f in all_found], pa.int64()), pa.array([b and b[1] for b in best], pa.string()), pa.array([b[2] if b else 0.0 for b in best]), pa.array([bool(b and b[3]) for b in best])]
            made.append(pa.array([[dict(zip(("line", "family", "probability", "confirmed"), x, strict=True)) for x in f] for f in all_found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=shape.names)

    return docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, shape)
