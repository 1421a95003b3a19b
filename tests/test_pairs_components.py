import itertools
import math
import random

import pytest

from tidemark.operators import pairs as P
from tidemark.operators.components import connected_components
from tidemark.operators.split import held_ranks, row_components
from tidemark.sources.tables import ROW


def brute(rows, near):
    return {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a, b)}


@pytest.mark.parametrize("seed,tolerances", [(1, (0.3, 0.3)), (2, (0.1, 0.0)), (3, (0.0, 0.0)), (4, (0.3, 2.0))])
def test_band_pairs_equal_the_naive_join(spark, seed, tolerances):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(30) / 10, float(rnd.randrange(4))) for i in range(120)] + [(120, 1e300, 0.0), (121, 1e300, 0.0), (122, -0.0, 0.0), (123, 0.0, 0.0)]
    df = spark.createDataFrame([(i, x + 0.0, y) for i, x, y in rows], f"{ROW} long, x0 double, x1 double")
    near = lambda a, b: abs(a[1] - b[1]) <= tolerances[0] and abs(a[2] - b[2]) <= tolerances[1]
    expected = brute(rows, near)
    pts = P.points(df, ["x0", "x1"])
    links = P.band_pairs(pts, dict(zip(["x0", "x1"], tolerances, strict=True)))
    labels = {i: "ab"[i % 2] if i % 5 else None for i, *_ in rows}
    members = df.join(pts.select("point", "x0", "x1"), ["x0", "x1"]).select(ROW, "point").join(spark.createDataFrame(list(labels.items()), f"{ROW} long, label string"), ROW)
    found = P.PairSummary(members, links)
    crossing = {(i, j) for i, j in expected if labels[i] and labels[j] and labels[i] != labels[j]}
    assert found.count() == len(expected)
    assert found.crossing_count() == len(crossing)
    assert {r[0] for r in found.rows().collect()} == {x for p in expected for x in p}
    assert {r[0] for r in found.crossing_rows().collect()} == {x for p in crossing for x in p}
    assert found.examples(False, 25) == [list(p) for p in sorted(expected)[:25]]
    assert found.examples(True, 25) == [list(p) for p in sorted(crossing)[:25]]


@pytest.mark.parametrize("radius", [0.0, 0.5, 1.0])
def test_neighbour_counts_equal_the_naive_count(spark, radius):
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(20) / 4, rnd.randrange(20) / 4) for i in range(100)]
    df = spark.createDataFrame(rows, f"{ROW} long, x0 double, x1 double")
    got = {r[0]: r[1] for r in P.neighbour_counts(df, ["x0", "x1"], radius).collect()}
    assert got == {a[0]: sum(b[0] != a[0] and math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= radius for b in rows) for a in rows}


def test_pair_budget():
    P.pair_budget(2000, 2_000_000)
    with pytest.raises(ValueError, match="exceeding"):
        P.pair_budget(2001, 2_000_000)


@pytest.mark.parametrize("threshold", [0.4, 1.0])
def test_tanimoto_pairs_equal_the_naive_join(spark, threshold):
    rnd = random.Random(4)
    prints = {tuple(rnd.choice([0, 1, 3, 7, -1]) for _ in range(2)) for _ in range(30)}
    rows = [(i, list(p)) for i, p in enumerate(sorted(prints))]
    ones = lambda v: sum(bin(x & (2**64 - 1)).count("1") for x in v)

    def score(a, b):
        common = ones([x & y for x, y in zip(a, b, strict=True)])
        return common / max(1, ones(a) + ones(b) - common)

    expected = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if ones(a) and ones(b) and score(a, b) >= threshold}
    df = spark.createDataFrame(rows, "point long, fp array<long>")
    assert {(r["a"], r["b"]) for r in P.tanimoto_pairs(df, threshold).collect()} == expected


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(5, 5)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101)], [(-(2**63), 2**63 - 1), (7, 2**63 - 1)],
    [(random.Random(k).randrange(60), random.Random(k + 1000).randrange(60)) for k in range(45)],
])
def test_components_equal_union_find(spark, links):
    df = spark.createDataFrame([*links, (3, None)], "u long, v long") if links else spark.createDataFrame([], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == union_find({x for p in links for x in p}, links)


def test_row_components_join_across_key_sets(spark):
    rows = spark.createDataFrame([(0, "a", None), (1, "b", None), (2, "b", "z"), (3, "c", "z"), (4, "z", "b")], f"{ROW} long, k string, g string")
    got = {r[0]: r[1] for r in row_components(rows, [["k"], ["g"]]).orderBy(ROW).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert {r[1] for r in row_components(rows, []).collect()} == {0, 1, 2, 3, 4}
    pairs = {r[0]: r[1] for r in row_components(rows, [["k", "g"]]).collect()}
    assert pairs == {i: i for i in range(5)}


def test_held_ranks_are_the_seeded_shuffle():
    order = list(range(6))
    random.Random(42).shuffle(order)
    assert held_ranks(6, 0.34, 42).tolist() == sorted(order[:3])
    assert len(held_ranks(2, 0.999, 1)) == 1 and len(held_ranks(10, 0.001, 1)) == 1
    with pytest.raises(ValueError):
        held_ranks(1, 0.5, 0)
