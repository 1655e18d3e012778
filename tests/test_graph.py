"""Components and longest paths against a listing of all simple paths, and on a graph of 100 000 classes."""

import random

import pytest

from lexispark.operators import graph


def listed(edges):
    out, above = [], {}
    for a, b in edges:
        if a != b:
            above.setdefault(a, set()).add(b)
    stack = [[a] for a in above]
    while stack:
        path = stack.pop()
        if len(path) > 1:
            out.append(path)
        stack += [[*path, b] for b in above.get(path[-1], ()) if b not in path]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_longest_paths_are_those_of_all(spark, seed):
    rng = random.Random(seed)
    names = [f"{'#' if rng.random() < 0.2 else ''}n{i}" for i in range(9)]
    edges = list({(rng.choice(names), rng.choice(names)) for _ in range(8 + 3 * seed)}) + [("p", "q"), ("q", "p"), ("q", "q")]
    edge = spark.createDataFrame(edges, "src string, dst string")
    every = listed(edges)
    for node, at in (("src", 0), ("dst", -1)):
        best = {}
        for path in every:
            best[path[at]] = min(best.get(path[at], (0, [])), (-len(path), path))
        want = {v: [x for x in p if not x.startswith("#")] for v, (_, p) in best.items()}
        assert {r[node]: r["path"] for r in graph.longest(edge, node).collect()} == want
    reach = {(p[0], p[-1]) for p in every}
    got = {}
    for r in graph.cycles(edge).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    nodes = {x for e in edges for x in e}
    want = {frozenset({v} | {w for w in nodes if (v, w) in reach and (w, v) in reach}) for v in nodes}
    assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}


def test_many_diamonds_and_cycles(spark):
    # 2 500 ladders of 12 steps: each has 2 ^ 12 paths, and a cycle at its foot
    n = 2500
    steps = [("a', id, '.', k", "b', id, '.', k"), ("a', id, '.', k", "c', id, '.', k"), ("b', id, '.', k", "a', id, '.', k + 1"), ("c', id, '.', k", "a', id, '.', k + 1")]
    each = ", ".join(f"struct(concat('{x}) AS src, concat('{y}) AS dst)" for x, y in steps)
    edge = spark.range(n).selectExpr("id", "explode(sequence(0, 11)) AS k").selectExpr(f"explode(array({each})) AS e").select("e.*")
    edge = edge.union(spark.range(n).selectExpr("concat('z', id) AS src", "concat('a', id, '.0') AS dst")).union(spark.range(n).selectExpr("concat('a', id, '.0')", "concat('z', id)"))
    got = graph.longest(edge, "src").where("src LIKE 'z%'").selectExpr("size(path) AS n", "path[2] AS p", "src").collect()
    assert len(got) == n and {r["n"] for r in got} == {26} and all(r["p"] == f"b{r['src'][1:]}.0" for r in got)


def test_no_edges(spark):
    assert graph.longest(spark.createDataFrame([], "src string, dst string"), "src").collect() == []
