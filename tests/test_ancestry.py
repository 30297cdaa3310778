"""Ancestry by pointer doubling against walks: deep chains, random forests, circles and absent parents."""

import random

import pytest

from heronlake.operators import stats

MOVES = "move_id int, id string, new_parent_id string"
NODES = "id string, parent_id string, node_type string"


def walk_cycle(parent, node, target):
    seen = set()
    while target is not None and target not in seen:
        if target == node:
            return True
        seen.add(target)
        target = parent.get(target)
    return False


@pytest.mark.parametrize("depth", [75, 10_000])
def test_deep_chains(spark, depth):
    nodes = spark.createDataFrame([(str(k), str(k - 1) if k else None, "folder") for k in range(depth)], NODES)
    end = str(depth - 1)
    moves = [(1, "0", end), (2, end, "0"), (3, "5", str(depth - 2)), (4, str(depth - 2), "5"), (5, "7", "7"), (6, "x", end)]
    got = {r.move_id: r.cycle for r in stats.creates_cycle(nodes, spark.createDataFrame(moves, MOVES)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    missing = nodes.where("id <> '0'").select("id")
    assert stats.prunable(nodes, missing).count() == depth - 1
    file = spark.createDataFrame([("f", str(depth - 10), "file")], NODES)
    assert {r.id for r in stats.prunable(nodes.unionByName(file), missing).collect()} == {str(k) for k in range(depth - 9, depth)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    """Parents may be absent, and some ways run in circles."""
    r = random.Random(seed)
    n = 60
    parent = {f"n{k}": r.choice([None, f"n{r.randrange(n)}", f"n{max(0, k - 1)}", f"n{max(0, k - 1)}", "absent"]) for k in range(n)}
    parent["n0"] = None if seed % 2 else "n7"
    kind = {k: r.choice(["folder", "folder", "folder", "file"]) for k in parent}
    nodes = spark.createDataFrame([(k, p, kind[k]) for k, p in parent.items()], NODES)
    moves = [(i, f"n{r.randrange(n)}", r.choice([None, *(f"n{r.randrange(n)}" for _ in range(8))])) for i in range(150)]
    got = {m.move_id: m.cycle for m in stats.creates_cycle(nodes, spark.createDataFrame(moves, MOVES)).collect()}
    assert got == {i: walk_cycle(parent, a, b) for i, a, b in moves} and any(got.values())

    missing = {k for k in parent if r.random() < 0.8}
    left = {k for k in parent if kind[k] == "folder" and k in missing}
    held, again = set(), True
    while again:
        now = {parent[k] for k in parent if k not in left - held} & left
        circle = {k for k in left if _on_circle({x: parent[x] for x in left}, k)}
        again, held = not (now | circle) <= held, held | now | circle
    assert {x.id for x in stats.prunable(nodes, spark.createDataFrame([(k,) for k in missing], "id string")).collect()} == left - held


def _on_circle(parent, node):
    at, seen = parent.get(node), set()
    while at is not None and at not in seen:
        if at == node:
            return True
        seen.add(at)
        at = parent.get(at)
    return False


def test_no_nodes(spark):
    none = spark.createDataFrame([], NODES)
    moves = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", None)], MOVES)
    assert {r.move_id: r.cycle for r in stats.creates_cycle(none, moves).collect()} == {1: False, 2: True, 3: False}
    assert stats.prunable(none, none.select("id")).count() == 0
