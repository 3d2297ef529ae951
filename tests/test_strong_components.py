import random

from textloom.operators import graph


def brute(edges):
    """node and the smallest node of its component, of components of two nodes and more."""
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    found = {n: [m for m in nodes if m in reach[n] and n in reach[m]] for n in nodes}
    return {n: min(found[n]) for n in nodes if len(found[n]) > 1}


def test_colours_are_numbers_and_names_come_back(spark, monkeypatch):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(95)}
    edges |= {("n70", "n71"), ("n71", "n9"), ("n9", "n100"), ("n100", "n70")}
    edges = {(a, b) for a, b in edges if a != b}
    kinds, coloured = [], graph._coloured
    monkeypatch.setattr(graph, "_coloured", lambda links: kinds.append(dict(links.dtypes)) or coloured(links))
    got = graph.strong_components(spark.createDataFrame(sorted(edges), "source string, target string")).collect()
    assert kinds == [{"source": "bigint", "target": "bigint"}]
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))
