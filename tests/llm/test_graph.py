"""Components and joins with hot keys against plain ways to the same answer; links of crowds stay few."""

import random

import pytest

from tests.llm.test_brute_force import _components
from tidemark.llm import graph, simhash


def _least(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in list(parent)}


def _shapes():
    random.seed(3)
    chain = [(k, k + 1) for k in range(500)]
    star = [(1000, 1001 + k) for k in range(300)] + [(2300, 2000 + k) for k in range(300)]
    sparse = [(random.randrange(3000, 3400), random.randrange(3000, 3400)) for _ in range(250)]
    mixed = [(5000 + (k * 37) % 101, 5000 + ((k + 1) * 37) % 101) for k in range(90)]
    return {"loop": [(7, 7)], "none": [], "all": chain + star + sparse + mixed + [(-4, 9), (9, -4)]}


@pytest.mark.parametrize("most", [graph.HOT, 20])
@pytest.mark.parametrize("name", sorted(_shapes()))
def test_components(spark, name, most):
    edges = _shapes()[name]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert got == {k: v for k, v in _least([e for e in edges if e[0] != e[1]]).items()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_as_others(spark, how):
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(900)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k long, w string")
    heavy = graph.heavy_keys(left.groupBy("k").count(), "k", "count", 100)
    assert heavy.count() == 1
    got, want = graph.spread_join(left, right, "k", heavy, how), left.join(right, "k", how)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("m", [300, 1200])
def test_links_of_a_crowd_grow_with_its_size(spark, m):
    random.seed(5)
    base, values = random.getrandbits(64), set()
    while len(values) < m:
        v = base
        for b in random.sample(range(64), random.randrange(1, 5)):
            v ^= 1 << b
        values.add(v - (1 << 64) if v >> 63 else v)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert links.count() <= 4 * m  # a task of the four gives a forest
    label = {r["node"]: r["label"] for r in graph.components(links).collect()}
    want = _components({v: v & ((1 << 64) - 1) for v in values})
    assert {v: label.get(v, v) for v in values} == want
