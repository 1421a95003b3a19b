import hashlib
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_dedup import components, naive_fingerprint
from tests.llm.test_models import naive_measures
from tidemark.llm import queries
from tidemark.llm import quality_classifier as Q
from tidemark.llm import quality_rules as R
from tidemark.llm.common import fold
from tidemark.runtime import materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    before = texts(docs)

    one = materialise(stages["quality classifier"](spark, docs, SF))
    model = Q.train(docs, labels, fold("doc_id", 3) != 1)
    good = {i for i, s in zip(before, model.scores([t.encode() for t in before.values()]), strict=True) if s >= 0.5}
    assert one.columns == COLUMNS and texts(one) == {i: before[i] for i in good}

    two = materialise(stages["quality rules"](spark, one, SF))
    rules, kept = R.train(one, labels), {}
    for i, t in texts(one).items():
        m = np.array([naive_measures(t)])
        if not (m[0, 0] < 10 or 100 * m[0, 4] > 20 * m[0, 0]) and rules.kept(m)[0]:
            kept[i] = t
    assert two.columns == COLUMNS and texts(two) == kept

    three = materialise(stages["simhash near-dedup"](spark, two, SF))
    prints = {i: naive_fingerprint(t) for i, t in kept.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    comp = components(prints, links)
    assert three.columns == COLUMNS and texts(three) == {i: kept[i] for i in kept if comp[i] == i} and links

    four = materialise(stages["source mix"](spark, three, SF))
    left, taken = texts(three), Counter()
    for r in four.collect():
        assert r["text"] in left[r["doc_id"]] or set(r["text"].split()) <= set(left[r["doc_id"]].split())
        taken[r["doc_id"]] += len(r["text"].split())
    assert four.columns == COLUMNS and all(k <= 2 * len(left[i].split()) for i, k in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(len(t.split()) for t in left.values()), rel=0.03)

    five = stages["byte-level bpe"](spark, four, SF).collect()
    ranks = __import__("tidemark.llm.byte_bpe", fromlist=["x"]).load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r["doc_id"], tuple(other.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in four.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in five) == expected


def test_stages_take_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c d e f g h i j k", "en", None, 3), (4, "a b c d e f g h i j k", None, "a", 3), (4, "a b c d e f g h i j k", None, "a", 3), (5, "q w e r t y u i o p " + " ".join(f"w{i}" for i in range(30_000)), "en", "b", 9)]
    docs = spark.createDataFrame([(*r, 1, True, 2.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, kept boolean, size double")
    spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            own = frame
            frame = materialise(stage(spark, frame, str(tmp_path)))
            assert name == "byte-level bpe" or frame.columns == own.columns
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = materialise(stage(spark, left, str(tmp_path)))
    assert sorted(r["doc_id"] for r in left.collect()) == [4, 5]


def test_names_of_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"
    assert queries.oracle_sql().keys() <= set(names)
