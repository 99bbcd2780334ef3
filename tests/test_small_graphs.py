"""Strong components and needless edges, in one task and by colours, against reachability by walking."""

import random

import numpy as np

from folium.operators import graph as g
from folium.operators.small_graphs import each_graph, needless, needless_of_run, strong, strong_of_run


def reach(n, edges):
    out = [set() for _ in range(n)]
    for a, b in edges:
        out[a].add(b)
    found = []
    for v in range(n):
        seen, left = set(), [v]
        while left:
            for w in out[left.pop()] - seen:
                seen.add(w)
                left.append(w)
        found.append(seen)
    return found


def random_graph(rng, n, m):
    return [(a, b) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} if a != b]


def test_walks_of_random_graphs():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        edges = random_graph(rng, n, rng.randint(0, 25))
        src, dst = (np.array([e[i] for e in edges], int) for i in (0, 1))
        ways, comp = reach(n, edges), strong(n, src, dst)
        assert all((comp[a] == comp[b]) == (a == b or (b in ways[a] and a in ways[b])) for a in range(n) for b in range(n))
        dag = [(a, b) for a, b in edges if a < b]
        src, dst = (np.array([e[i] for e in dag], int) for i in (0, 1))
        ways = reach(n, dag)
        assert needless(n, src, dst) == [any(b in ways[c] for x, c in dag if x == a) for a, b in dag]


def test_a_long_cycle_is_walked_without_recursion():
    n = 20_000
    comp = strong(n, np.arange(n), (np.arange(n) + 1) % n)
    assert set(comp) == {0}


def frames(spark, graphs):
    nodes = [(r, v) for r, (n, _) in graphs.items() for v in range(n)]
    edges = [(r, a, b) for r, (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(nodes, "run_id string, id long"), spark.createDataFrame(edges, "run_id string, src long, dst long")


def test_both_ways_agree(spark):
    rng = random.Random(2)
    graphs = {f"r{i}": (n := rng.randint(2, 14), random_graph(rng, n, rng.randint(1, 30))) for i in range(25)}
    graphs["two rings"] = (10, [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 1) % 5) for i in range(5)] + [(0, 7)])
    nodes, edges = frames(spark, graphs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = []
    for r, (n, es) in graphs.items():
        ways = reach(n, es)
        want += [(r, v, min([v, *(w for w in ways[v] if v in ways[w])])) for v in range(n)]
    assert rows(g.strong_components(nodes, edges)) == sorted(want)
    assert rows(g.strong_components(nodes, edges, most=12)) == sorted(want)  # larger ones by colours
    assert rows(g.reduced_edges(nodes, edges)) == rows(g.reduced_edges(nodes, edges, most=12))


def test_colours_travel_a_long_cycle_in_few_rounds(spark, monkeypatch):
    n = 2_000
    ids = np.random.default_rng(0).permutation(n).tolist()
    cycle = [(ids[i], ids[(i + 1) % n]) for i in range(n)]
    nodes, edges = frames(spark, {"big": (n, cycle), "small": (3, [(0, 1), (1, 0), (1, 2)])})
    rounds, real = [], g.Steps.put
    monkeypatch.setattr(g.Steps, "put", lambda self, df: rounds.append(1) or real(self, df))
    out = {(r["run_id"], r["id"]): r["component"] for r in g.strong_components(nodes, edges, most=100).collect()}
    assert all(out["big", i] == 0 for i in range(n)) and [out["small", i] for i in range(3)] == [0, 0, 2]
    assert len(rounds) < 120


def test_the_plan_keeps_runs_whole(spark):
    """Dealt rows alone are not kept together where Spark changes a join below as it runs; grouped rows are."""
    _, edges = frames(spark, {"r": (3, [(0, 1), (1, 0), (1, 2)])})
    found = each_graph(edges, strong_of_run, "id long, root long")
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("r", 0, 0), ("r", 1, 0), ("r", 2, 2)]


def test_a_graph_without_needless_edges_gives_no_rows(spark):
    _, edges = frames(spark, {"r": (3, [(0, 1), (1, 2)]), "s": (3, [(0, 1), (1, 2), (0, 2)])})
    assert list(map(tuple, each_graph(edges, needless_of_run, "a long, b long").collect())) == [("s", 0, 2)]


def test_weak_components_of_small_graphs_take_no_rounds(spark, monkeypatch):
    from folium.operators import components as c

    rng = random.Random(5)
    graphs = {f"r{i}": (n := rng.randint(2, 40), random_graph(rng, n, rng.randint(1, 40))) for i in range(12)} | {"chain": (300, [(i + 1, i) if i % 2 else (i, i + 1) for i in range(299)])}
    nodes, edges = frames(spark, graphs)
    of = lambda most: {tuple(r) for r in g.weak_components(nodes, edges, most).collect()}
    by_rounds, rounds, real = of(0), [], c.Steps.put
    monkeypatch.setattr(c.Steps, "put", lambda self, df: rounds.append(1) or real(self, df))
    assert of(1000) == by_rounds and not rounds and ("chain", 299, 0) in by_rounds


def test_families_are_made_once(spark, monkeypatch):
    kept, real = [], g.saved
    monkeypatch.setattr(g, "saved", lambda df, name: kept.append(name) or real(df, name))
    nodes = spark.createDataFrame([("r", i, f"t{i}", 2000 + i, "s", "f" if i < 2 else None, 0.5) for i in range(4)], "run_id string, id long, title string, year int, source string, family string, relevance double")
    visual, moved = g.collapse_families(nodes, spark.createDataFrame([("r", 0, 2), ("r", 1, 2), ("r", 0, 1)], "run_id string, src long, dst long"))
    assert {(r["visual_id"], tuple(r["members"])) for r in visual.collect()} == {("family:f", (0, 1)), ("paper:2", (2,)), ("paper:3", (3,))}
    assert [tuple(r) for r in moved.collect()] == [("r", "family:f", "paper:2")] and kept == ["family-nodes"]
