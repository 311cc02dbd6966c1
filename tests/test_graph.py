"""Cycles and reachability against slow searches, and the number of rounds of long paths."""

import random

import pytest
from conftest import rows

from siftline.operators import graph


def reach(edges, start):
    seen, todo = set(), [b for a, b in edges if a == start]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += out.get(x, [])
    return seen


def slow_components(edges):
    names = {x for e in edges for x in e}
    to = {x: reach(edges, x) for x in names}
    return sorted((x, min(y for y in to[x] if x in to[y])) for x in names if x in to[x])


def tables(spark, edges, extra=()):
    names = {x for e in edges for x in e} | set(extra)
    nodes = spark.createDataFrame([(x,) for x in sorted(names)], "node int")
    return nodes, spark.createDataFrame(edges, "node int, dependency int")


@pytest.fixture
def writes(monkeypatch):
    written = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(label) or keep(df, label))
    return written


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5)],  # two cycles and a bridge
        [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (9, 1), (1, 1), (8, 8), (8, 1)],  # cycles that share a node, loops
        [(1, 2), (2, 3), (1, 3), (3, 4)],  # none
        [(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (2, 2), (2, 5), (5, 6), (6, 5), (6, 2), (1, 2)],
    ],
)
def test_components_of_small_graphs(spark, edges):
    assert rows(graph.strong_components(*tables(spark, edges))) == sorted(slow_components(edges), key=lambda r: [(True, str(x)) for x in r])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range((35, 50, 90)[seed - 1])]
    assert sorted(tuple(r) for r in graph.strong_components(*tables(spark, edges)).collect()) == slow_components(edges)


def test_unknown_nodes_and_empty_tables(spark, frame):
    nodes = frame("node int", (1,), (2,))
    edges = frame("node int, dependency int", (1, 7), (7, 1), (1, 2))
    assert graph.strong_components(nodes, edges).count() == 0
    assert rows(graph.bad_edges(nodes, edges.filter("node = 1"))) == [(7, "unknown")]
    assert graph.strong_components(nodes, edges.limit(0)).count() == 0


def test_a_long_path_and_a_long_cycle_take_few_rounds(spark, writes):
    n = 20_000
    nodes = spark.range(2 * n).selectExpr("cast(id AS int) AS node")
    path = spark.range(n - 1).selectExpr("cast(id AS int) AS node", "cast(id + 1 AS int) AS dependency")
    ring = spark.range(n).selectExpr(f"cast(id + {n} AS int) AS node", f"cast((id + 1) % {n} + {n} AS int) AS dependency")
    got = graph.strong_components(nodes, path.unionByName(ring))
    assert got.distinct().count() == n
    assert rows(got.select("component").distinct()) == [(n,)]
    assert writes.count("chase") <= 40


def slow_ancestors(edges, nodes, done):
    todo = [x for x in nodes if x not in {b for _, b in edges}]
    seen = set()
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            if x not in done:
                todo += [b for a, b in edges if a == x]
    return sorted(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a != b]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(130, 5)]
    done = {rng.randrange(60) for _ in range(8)} | {120 * seed}
    nodes, table = tables(spark, edges)
    found = graph.ancestors(nodes, table, spark.createDataFrame([(x,) for x in done], "node int"))
    assert sorted(r.node for r in found.collect()) == slow_ancestors(edges, [r.node for r in nodes.collect()], done)


def test_a_chain_of_open_nodes_takes_few_rounds(spark, writes):
    n = 10_000
    nodes = spark.range(n).selectExpr("cast(id AS int) AS node")
    edges = spark.range(n - 1).selectExpr("cast(id AS int) AS node", "cast(id + 1 AS int) AS dependency")
    got = graph.ancestors(nodes, edges, nodes.limit(0))
    assert got.count() == got.distinct().count() == n
    assert writes.count("tail") <= 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\n") < 5
