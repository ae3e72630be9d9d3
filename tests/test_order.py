"""Cycles, levels and rerun order of data set graphs against plain versions."""

from __future__ import annotations

import random

import pytest

from millrace.operators.lineage import order

EDGES = "out_dataset STRING, in_dataset STRING"


def _graph(spark, edges):
    return spark.createDataFrame([(f"d{a}", f"d{b}") for a, b in edges], EDGES)


def _reach(edges):
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    found = {}
    for node in {n for edge in edges for n in edge}:
        seen, todo = set(), [node]
        while todo:
            for other in onward.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        found[node] = seen
    return found


def _plain(edges):
    """Cycle and level of every node, from the closure."""
    reach = _reach(edges)
    cycle = {
        n: min(f"d{m}" for m in reach if m == n or (m in reach[n] and n in reach[m])) for n in reach
    }
    whole = {n: any(m != n and m in reach[n] and n in reach[m] for m in reach) for n in reach}
    steps = {(cycle[a], cycle[b]) for a, b in edges if cycle[a] != cycle[b]}
    level = dict.fromkeys(cycle.values(), 0)
    for _ in level:
        for a, b in steps:
            level[a] = max(level[a], level[b] + 1)
    return {f"d{n}": cycle[n] for n in reach if whole[n]}, {f"d{n}": level[cycle[n]] for n in reach}


GRAPHS = {
    "chain": [(k + 1, k) for k in range(12)],
    "diamonds": [(k + d, k) for k in range(0, 12) for d in (1, 2, 3)],
    "one cycle": [(1, 2), (2, 3), (3, 1)],
    "itself": [(1, 1), (2, 1)],
    "cycles in a row": [(1, 2), (2, 1), (3, 2), (4, 3), (3, 4), (5, 4), (5, 1)],
    "cycles that share a node": [(1, 2), (2, 1), (2, 3), (3, 2), (9, 3), (1, 0)],
    "a way between cycles": [(1, 2), (2, 1), (5, 1), (6, 5), (7, 6), (8, 7), (7, 8), (6, 6)],
    "names against the flow": [(9, 8), (8, 7), (7, 9), (1, 9), (2, 1), (1, 2)],
    "random": sorted({tuple(random.Random(k).sample(range(30), 2)) for k in range(45)}),
    "random, dense": sorted({tuple(random.Random(k + 99).sample(range(14), 2)) for k in range(40)}),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_cycles_and_levels(spark, name):
    edges = _graph(spark, GRAPHS[name] * 2)
    cycles, levels = _plain(GRAPHS[name])
    found = order.cycles(edges)
    assert {r.dataset: r.cycle for r in found.collect()} == cycles
    assert {r.dataset: r.level for r in order.levels(edges, found).collect()} == levels


def test_no_edges(spark):
    empty = _graph(spark, [])
    assert order.cycles(empty).count() == order.levels(empty).count() == 0
    assert order.rerun_order(empty, spark.createDataFrame([("d1",)], "dataset STRING")).count() == 0


def test_a_missing_cycle_is_an_error(spark):
    edges = _graph(spark, GRAPHS["one cycle"])
    with pytest.raises(ValueError, match="every cycle"):
        order.levels(edges, order.cycles(edges).limit(0))


def test_rerun_order_is_what_failed_and_what_it_feeds(spark):
    edges = _graph(spark, [(2, 1), (3, 2), (4, 3), (4, 1), (5, 1), (6, 4), (8, 7)])
    failed = spark.createDataFrame([("d2",), ("d5",), ("d2",)], "dataset STRING")
    found = {r.dataset: r.level for r in order.rerun_order(edges, failed).collect()}
    assert found == {"d2": 1, "d3": 2, "d4": 3, "d5": 1, "d6": 4}
    for a, b in [(3, 2), (4, 3), (6, 4)]:
        assert found[f"d{a}"] > found[f"d{b}"]
