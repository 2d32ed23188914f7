"""Components, paths, weights and communities against brute force."""

import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import communities, graph

EDGES = "parent string, child string"


def reach(links):
    nodes = sorted({x for e in links for x in e})
    to = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in links:
            to[a] |= to[b]
    for _ in nodes:
        for a, b in links:
            to[a] |= to[b]
    return to


def plain_components(links):
    to = reach(links)
    return {n: min(m for m in to[n] if n in to[m]) for n in to}


@settings(max_examples=2, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 14), st.floats(0.5, 2.0))
def test_components_of_random_graphs(spark, seed, n, density):
    draw = random.Random(seed)
    links = [(f"n{draw.randrange(n):02d}", f"n{draw.randrange(n):02d}") for _ in range(int(n * density) + 1)]
    edges = spark.createDataFrame(links + links[:2], EDGES)
    want = plain_components(links)
    assert {r.node: r.component for r in graph.components(edges).collect()} == want
    size = {c: sum(v == c for v in want.values()) for c in want.values()}
    cyclic = {n for n in want if size[want[n]] > 1 or (n, n) in links}
    assert {r.node for r in graph.in_cycles(edges).collect()} == cyclic


def test_components_with_nulls_and_without_rows(spark):
    edges = spark.createDataFrame([("a", None), (None, "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("e", "d")], EDGES)
    assert {tuple(r) for r in graph.components(edges).collect()} == {("c", "c"), ("d", "d"), ("e", "d")}
    assert graph.components(edges.where("false")).count() == graph.in_cycles(edges.where("false")).count() == 0
    assert {tuple(r) for r in graph.components(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "parent long, child long")).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_two_components_of_one_colour(spark):
    """The least node reaches both; the second is found in the next round."""
    links = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("w", "z")]
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(links, EDGES)).collect()} == plain_components(links)


def test_short_cycles(spark):
    """Cycles by length, with hubs and without; many nodes around few hubs make no pairs of those nodes."""
    draw = random.Random(8)
    links = [*{(draw.randrange(25), draw.randrange(25)) for _ in range(45)}, *((100 + i, 0) for i in range(9)), *((0, 100 + i) for i in range(4, 9)), (200, 200)]
    edges = spark.createDataFrame([*links, links[0], (None, 1), (2, None), (None, None)], "parent long, child long")
    for depth in (1, 2, 3, 4, 5):
        at, step = {(n, n) for e in links for n in e}, set()
        want = set()
        for _ in range(depth):
            step = {(a, c) for a, b in at for x, c in links if x == b}
            want |= {a for a, b in step if a == b}
            at = step
        assert {r.node for r in graph.in_cycles(edges, depth).collect()} == want


def test_short_cycles_make_no_pairs_of_a_hubs_nodes(spark):
    """Each of 3,000 nodes leads to one node, which leads to all: walks of three links join 9 million pairs."""
    n = spark.range(1, 3001)
    edges = n.select(F.col("id").alias("parent"), F.lit(0).cast("long").alias("child")).union(n.select(F.lit(-1).cast("long"), "id")).union(spark.sql("SELECT 0L, -1L"))
    most, stored = [], graph.stored

    def counted(df, name):
        out = stored(df, name)
        most.append(out.count())
        return out

    graph.stored = counted
    try:
        assert graph.in_cycles(edges, 3).count() == 3002
    finally:
        graph.stored = stored
    assert max(most) < 30_000


LINKS = [("i1", "part", "i2"), ("i2", "part", "root"), ("i3", "sub", "root"), ("i4", "sub", "i3"), ("i3", "sub", "i4"), ("i5", "part", "i4"), ("i6", "is", "k"), ("i7", "is", "l"), ("l", "sub", "k"), ("i8", "about", "i4"), ("i9", "about", "i1"), ("i5", "part", "i2")]


def test_paths_to_targets(spark):
    links = spark.createDataFrame(LINKS, "item string, relation string, to string")
    at = lambda x: spark.createDataFrame([(x,), (x,)], "item string")
    got = lambda *a: {r.item for r in graph.reaching(links, *a).collect()}
    assert got("part", at("root")) == {"root", "i1", "i2", "i5"}
    assert got("sub", at("root"), "part") == {"i2", "i5"} and got("sub", at("root")) == {"root", "i3", "i4"}
    assert got("sub", at("k"), "is") == {"i6", "i7"} and got("none", at("q")) == {"q"}
    articles = spark.createDataFrame([("i1", "A1"), ("i5", "A5"), ("i5", "A5b")], "item string, article string")
    rows = graph.topic_items(links, [(None, "part", at("root")), ("part", "sub", at("root")), ("is", "sub", at("k")), ("about", "sub", at("root"))], articles, "part")
    want = {("root", None, None), ("i1", "A1", "i2"), ("i2", None, "root"), *product(("i5",), ("A5", "A5b"), ("i4", "i2")), ("i6", None, None), ("i7", None, None), ("i8", None, None)}
    found = [tuple(r) for r in rows.collect()]
    assert set(found) == want and len(found) == len(want)


def test_weights_are_those_of_power_iteration(spark):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("q", "d"), ("x", "y"), ("d", "d"), ("r", "a"), (None, "a")]
    edges = spark.createDataFrame(links, EDGES)
    roots = spark.createDataFrame([("r",), ("q",), ("alone",)], "node string")
    nodes = sorted({n for e in links for n in e if n} | {"alone"})
    at = {n: i for i, n in enumerate(nodes)}
    step = np.zeros((len(nodes), len(nodes)))
    real = {e for e in links if e[0]}
    for a, b in real:
        step[at[b], at[a]] = 0.6 / sum(x == a for x, _ in real)
    start = np.array([0.4 / 3 if n in ("r", "q", "alone") else 0 for n in nodes])
    weight = start.copy()
    for _ in range(200):
        weight = start + step @ weight
    got = {r.node: r.weight for r in graph.depth_weights(edges, roots, 0.6, 1e-4).collect()}
    assert set(got) == set(nodes) and max(abs(got[n] - weight[at[n]]) for n in nodes) < 1e-4
    assert got["y"] == 0 and got["a"] > got["c"] * 0.6
    with pytest.raises(ValueError):
        graph.depth_weights(edges, roots, 1.0)


def plain_modularity(links, of):
    m = sum(w for _, _, w in links)
    degree, inside = {}, 0.0
    for a, b, w in links:
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
        inside += w if of[a] == of[b] else 0
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_modularity_of_partitions(spark):
    draw = random.Random(4)
    links = [(a, b, float(draw.randint(1, 5))) for a in range(12) for b in range(a, 12) if draw.random() < 0.3]
    nodes = {x for a, b, _ in links for x in (a, b)}
    df = spark.createDataFrame(links, "a long, b long, weight double")
    for k in (1, 3, 12):
        of = {n: n % k for n in nodes}
        members = spark.createDataFrame(list(of.items()), "node long, community long")
        assert abs(communities.modularity(df, members) - plain_modularity(links, of)) < 1e-12
        assert abs(communities.modularity(communities.contracted(df, members), spark.createDataFrame([(c, c) for c in set(of.values())], "node long, community long")) - plain_modularity(links, of)) < 1e-12


def test_communities_of_cliques(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0"), ("b1", "c1"), ("a2", None)], EDGES)
    links = communities.undirected(edges)
    levels = communities.louvain(links)
    rows = [tuple(r) for r in links.collect()]
    values = [x.modularity for x in levels]
    assert values == sorted(values) and len(values) >= 1
    for level in levels:
        of = {r.node: r.community for r in level.members.collect()}
        assert len(of) == 12 and abs(level.modularity - plain_modularity(rows, of)) < 1e-9
    groups = {}
    for node, c in of.items():
        groups.setdefault(c, set()).add(node[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"], ["c"]]
    assert communities.louvain(links.where("false")) == []
