import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import embedding_dedup as E
from tidemark.llm import simhash_dedup as S


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, run = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, run = words + [run] * bool(run), ""
        else:
            run += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_naive_ones(monkeypatch):
    rnd = random.Random(1)
    texts = ["", " \n", "One", "one two", "A b C", "É é Ü x\x0by\x0cz\r", "a b c d " * 300] + [" ".join(rnd.choice("ab cd EF ğ 漢".split()) for _ in range(rnd.randrange(40))) for _ in range(40)]
    monkeypatch.setattr(S, "CHUNK", 100)
    assert [S.fingerprint(t.encode()) for t in texts] == [naive_fingerprint(t) for t in texts]


@pytest.mark.parametrize("partitions", [2, 3, 4])
def test_every_near_pair_is_found(spark, monkeypatch, partitions):
    rnd = random.Random(partitions)
    monkeypatch.setattr(S, "partition_count", lambda n, r: partitions)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    values = set(seeds)
    for s in seeds[:25]:
        for k in range(5):
            values.add(s ^ sum(1 << b for b in rnd.sample(range(64), k)))
    base = seeds[0] & ~0xFFFF  # a crowd that shares three partitions of four
    values |= {base | rnd.getrandbits(16) for _ in range(60)}
    v = np.array(sorted(values), np.uint64).view(np.int64)
    near = np.bitwise_count(v[:, None].view(np.uint64) ^ v[None, :].view(np.uint64)) <= 3
    expected = {(min(a, b), max(a, b)) for i, a in enumerate(v.tolist()) for j, b in enumerate(v.tolist()) if i != j and near[i, j]}
    got = {(r["a"], r["b"]) for r in S.near_links(spark.createDataFrame([(x,) for x in v.tolist()], "fp long")).collect()}
    assert got == expected and len(expected) > 100


def test_thresholds_cover_the_radius_and_follow_counts():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 62, 500)
    fps[:400] &= ~np.int64(0xFFFF)  # one partition says nothing for most
    places = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    hists = [np.bincount(S._project(fps, p), minlength=1 << 16) for p in places]
    made = S.Plan(places, hists, 3, probe_cost=0.01)
    limits = made.thresholds([S._project(fps, p) for p in places])
    assert (limits.sum(1) == 0).all() and limits.min() >= -1
    assert (limits[:400, 0] == -1).all()


def test_bits_that_go_together_are_grouped():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (2000, 64)).astype(float)
    for b in range(1, 16):
        bits[:, 4 * b % 64] = bits[:, 0]
    groups = S.group_bits(bits.T @ bits, 2000, 4)
    assert sorted(x for g in groups for x in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({4 * b % 64 for b in range(16)} == set(g) for g in groups)


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (5, "x " * 60_000), (6, "Alone here now"), (None, "nobody knows me")]


def test_documents_with_edges(spark):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in EDGES], "doc_id long, text string, fp int, id int, row int")
    got = [(r[0], r[1], r[2]) for r in S.deduplicate(df).collect()]
    prints = {(i, f"{naive_fingerprint(t):016x}") for i, t in EDGES}
    assert {(i, f) for i, f, _ in got} == prints and len(got) == len(EDGES)
    assert sorted((i, c) for i, _, c in got if i) == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6)]
    assert sorted((c is None, c) for i, _, c in got if i is None) == [(False, 4), (True, None)]
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted((r[0] is None, r[0]) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, None)]
    assert S.deduplicate(df.where("false")).count() == 0 == S.keep_one(df.where("false")).count()


def vectors(seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(0, n, 3):
        x[i + 1] = x[i] + 0.12 * np.linalg.norm(x[i]) * rng.standard_normal(16) / 4
    x[60:120] = x[0] + 0.02 * rng.standard_normal((60, 16))  # a crowd
    x[121] = x[120]
    return [(i, [float(np.float32(v)) for v in row], i % 3 if 60 <= i < 120 or i in (120, 121) else 0) for i, row in enumerate(x)]


def brute(rows, threshold=0.93):
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in ok])
    label = np.array([r[2] for r in ok])
    near = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in ok]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    comp = components([r[0] for r in rows], links)
    count = {i: int(n) for i, n in zip(ids, near.sum(1), strict=True)}
    return {r[0]: (count.get(r[0], 0), comp[r[0]], comp[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "VISITORS", block)
    rows = [*vectors(), (900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, float("nan")] + [0.0] * 14, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, vectors()[0][1], None), (905, [3.0, 4.0], 0), (906, [6.0, 8.0], 0), (907, [], 0)]
    rows = [(i, v, k) for i, v, k in rows]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, label int, v double, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.link(df, recall=0.995).collect()}
    same = [r for r in rows if len(r[1] or []) == 16]
    expected = brute([r for r in same]) | {900: (0, 900, True), 905: (1, 905, True), 906: (1, 905, False), 907: (0, 907, True)}
    found, wanted = sum(x[0] for x in got.values()), sum(x[0] for x in expected.values())
    assert got.keys() == expected.keys() and all(got[i][0] <= expected[i][0] for i in got)
    assert found >= 0.98 * wanted and wanted > 1000
    assert all(got[i] == expected[i] for i in (120, 121, 900, 901, 902, 903, 904, 905, 906, 907))


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.link(df).collect())
    assert got == [(False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 1, 2, True), (True, None, 1, 2, False)]
    assert E.link(df.where("false")).count() == 0
    none = E.link(df.where("vec_id = 2").selectExpr("vec_id", "cast(null AS array<double>) AS embedding", "label")).collect()
    assert [tuple(r) for r in none] == [(2, 0, 2, True)]


def test_recall_is_what_was_asked_for():
    rng = np.random.default_rng(5)
    x = E.unit(rng.standard_normal((3000, 32)))
    index = E.MultiIndex.fit(x, 8, 0.93, 0.97)
    y = E._apart(x, 0.93, rng, slice(None))
    (hx, rows, cells), hy = index.visits(x), index.visits(y)
    visited = set(zip(rows.tolist(), cells.tolist(), strict=True))
    back = set(zip(hy[1].tolist(), hy[2].tolist(), strict=True))
    met = [(i, hy[0][i]) in visited if hx[i] <= hy[0][i] else (i, hx[i]) in back for i in range(len(x))]
    assert np.mean(met) > 0.94
    assert len(visited) < 0.8 * len(x) * 64


def planted(n=3000, d=24, seed=2):
    """Vectors of two labels; pairs from the threshold upwards, apart in any direction or in one half alone; a crowd that fills a cell."""
    rng = np.random.default_rng(seed)
    x = E.unit(rng.standard_normal((n, d)) + 0.6 * rng.standard_normal((1, d)))
    wheres = [slice(None), slice(0, d // 2), slice(d // 2, None)]
    pairs = [E._apart(x[i : i + 1], 0.9305 + 0.06 * rng.random() ** 2, rng, wheres[i % 3])[0] for i in range(0, n, 2)]
    crowd = [E._apart(x[1:2], 0.97, rng, slice(None))[0] for _ in range(1500)]
    rows = [*x, *pairs, *crowd]
    labels = [*(i % 2 for i in range(n)), *(i % 2 for i in range(0, n, 2)), *[1] * len(crowd)]
    return [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(rows, labels, strict=True))]


def test_recall_of_planted_links_with_the_settings_of_production(spark):
    rows = planted()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    x, label = E.unit([r[1] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    expected = near.sum(1)
    found = np.array([got[i][0] for i in range(len(rows))])
    thin = expected <= 3  # outside the crowd, where most links are
    assert (found <= expected).all() and found.sum() >= 0.95 * expected.sum() and found[thin].sum() >= 0.95 * expected[thin].sum() and expected[thin].sum() > 1500


def test_blocks_of_a_cell_are_dealt_out_on_their_own(spark):
    rows = [(i, [1.0, i / 1e4], "a") for i in range(200)]
    classes = spark.createDataFrame([(i, 1, np.array(v, np.float64).tobytes(), k) for i, v, k in rows], "class long, times long, v binary, label string")
    plan = E._meetings(classes, np.float64, 0.93, 0.97, 100, 1)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any(all(f"{c}#" in line.split("hashpartitioning(")[1] for c in ("label", "size", "cell", "r", "w")) for line in dealt)
    after = plan[: plan.index("hashpartitioning(")]
    assert "FlatMapGroupsInArrow" in after and "Exchange" in after and "Join" not in after


def test_vectors_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(E, "INDEXED", 2)
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for size, n in ((1, 9), (3, 60), (4, 50), (5, 40), (700, 5)):
        x = rng.standard_normal((n, size))
        x[n // 2 :] = x[: n - n // 2] * 2 + 0.01 * rng.standard_normal((n - n // 2, size))
        rows += [(len(rows) + i, v.tolist(), "a") for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), recall=0.999).collect()}
    expected = {}
    for size in {len(r[1]) for r in rows}:
        expected |= brute([r for r in rows if len(r[1]) == size])
    assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in expected.values())
    rest = [i for i, v, _ in rows if len(v) not in (3, 4)]  # compared with all
    assert [got[i] for i in rest] == [expected[i] for i in rest]
