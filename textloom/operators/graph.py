"""Network measures as joins and groupings over edge tables (source, target).

Loops write each round's state to the shared folder and remove the round before: plans stay
short and survive lost executors.  Only counts reach the driver.
Iterated scores (``operators/centrality.py``) work on many graphs at once; ``page_rank`` and
``eigenvector`` are their forms for one graph.
Measures over all shortest paths (closeness, betweenness) keep a row for each origin and node
that it reaches; ``batches`` works on so many parts of the origins one after another, with the
same result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import forget, written
from textloom.operators import centrality


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.select("source", "target").filter("source <> target").distinct()


def degrees(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """In- and out-degree of every node, isolated ones included."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("source").alias(node), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("target").alias(node), F.lit(0).alias("out"), F.lit(1).alias("in")))))
    sums = ends.groupBy(node).agg(F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"))
    return nodes.select(node).distinct().join(sums, node, "left").na.fill(0, ["in_degree", "out_degree"])


def summary(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes, edges, isolated nodes and density."""
    d = degrees(edges, nodes, node)
    counts = d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"))
    return counts.withColumn("density", F.try_divide("edges", F.col("nodes") * (F.col("nodes") - 1)))


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """An undirected edge table as directed edges in both directions."""
    w = [F.col(weight).alias(weight)] if weight else []
    return edges.select(F.inline(F.array(F.struct("source", "target", *w), F.struct(F.col("target").alias("source"), F.col("source").alias("target"), *w))))


def page_rank(edges: DataFrame, nodes: DataFrame, node: str = "node", weight: str | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, scaled: bool = True) -> DataFrame:
    """PageRank with dangling weight spread evenly.

    Stops when the absolute changes add up to less than the tolerance (times the number of nodes if scaled).
    Where the rounds end before that, the last scores stand; ``centrality.page_ranks`` tells so.
    """
    found = centrality.page_ranks(_one_graph(edges), _one_graph(nodes), node, weight, damping, rounds, tolerance, scaled)
    return found.scores.select(node, "score")


def eigenvector(edges: DataFrame, nodes: DataFrame, node: str = "node", weight: str | None = None, shifted: bool = False, rounds: int = 1000, tolerance: float = 1e-6, zero_on_failure: bool = False) -> DataFrame:
    """Power iteration over incoming edges (give both directions of undirected ones).

    Starts from equal scores, scales to length 1; all zero if the length becomes 0.
    Shifted adds each node's own score, which converges on bipartite networks too.
    Where the rounds end before convergence the last scores stand, or zeros if asked for.
    """
    found = centrality.eigenvectors(_one_graph(edges), _one_graph(nodes), node, weight, shifted, rounds, tolerance, zero_on_failure)
    return found.scores.select(node, "score")


def _one_graph(table: DataFrame) -> DataFrame:
    return table.withColumn("graph", F.lit(0))


def shortest_paths(edges: DataFrame, sources: DataFrame, node: str = "node", longest: int | None = None) -> DataFrame:
    """origin, node, distance and paths (their number), level by level from all sources at once; longer paths than ``longest`` are left out if it is given."""
    links = written(simple_edges(edges))
    frontier = written(sources.select(F.col(node).alias("origin"), F.col(node).alias("node"), F.lit(0).alias("distance"), F.lit(1).cast("long").alias("paths")).distinct())
    found, parts = frontier, [frontier]
    for d in count(1):
        if longest is not None and d > longest:
            break
        reached = frontier.join(links, F.col("node") == F.col("source")).groupBy("origin", F.col("target").alias("node")).agg(F.sum("paths").alias("paths"))
        frontier = written(reached.join(found, ["origin", "node"], "left_anti").select("origin", "node", F.lit(d).alias("distance"), "paths"))
        parts.append(frontier)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if d % 8 == 0:  # plans stay short
            found = written(found)
            forget(*parts[:-1])
            parts = [found, frontier]
    return found


def _origin_batches(nodes: DataFrame, node: str, batches: int) -> list[DataFrame]:
    origins = nodes.select(node).distinct()
    return [origins] if batches == 1 else [origins.filter(F.pmod(F.xxhash64(node), F.lit(batches)) == k) for k in range(batches)]


def closeness(paths: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Closeness of each origin, scaled by the share of nodes that it reaches."""
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    sums = paths.groupBy(F.col("origin").alias(node)).agg(F.sum("distance").alias("total"), F.count("*").alias("reached")).crossJoin(n)  # one row
    r = F.col("reached") - 1
    return sums.select(node, F.coalesce(F.try_divide(r, "total") * F.try_divide(r, F.col("n") - 1), F.lit(0.0)).alias("score"))


def betweenness(edges: DataFrame, nodes: DataFrame, node: str = "node", batches: int = 1) -> DataFrame:
    """Share of shortest paths through each node, normalised by (n - 1)(n - 2).

    Paths are counted outward level by level, then dependencies are added up inward.
    Give both directions of an undirected network; ordered pairs count there as here.
    """
    links = written(simple_edges(edges))
    n = nodes.select(node).distinct().count()
    parts = [_dependencies(links, origins, node) for origins in _origin_batches(nodes, node, batches)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy(F.col("node").alias(node)).agg(F.sum("total").alias("total"))
    scale = max((n - 1) * (n - 2), 1)
    return nodes.select(node).distinct().join(sums, node, "left").select(node, (F.coalesce("total", F.lit(0.0)) / scale).alias("score"))


def _dependencies(links: DataFrame, origins: DataFrame, node: str) -> DataFrame:
    """node and total of the dependencies of some origins on it."""
    paths = written(shortest_paths(links, origins, node))
    far = paths.agg(F.max("distance")).first()[0] or 0
    level = paths.filter(F.col("distance") == far).select("origin", "node", "paths", F.lit(0.0).alias("dependency"))
    totals = []
    for d in range(far, 0, -1):
        totals.append(level.filter("origin <> node").groupBy("node").agg(F.sum("dependency").alias("total")))
        if d > 1:
            # sent to predecessors one level nearer, by their share of the paths
            sent = level.join(links, F.col("node") == F.col("target")).select("origin", F.col("source").alias("node"), ((1 + F.col("dependency")) / F.col("paths")).alias("part"))
            sums = sent.groupBy("origin", "node").agg(F.sum("part").alias("part"))
            here = paths.filter(F.col("distance") == d - 1)
            level = written(here.join(sums, ["origin", "node"], "left").select("origin", "node", "paths", F.coalesce(F.col("part") * F.col("paths"), F.lit(0.0)).alias("dependency")))
    every = origins.select(F.col(node).alias("node"), F.lit(0.0).alias("total")).limit(0)
    for part in totals:
        every = every.unionByName(part)
    return written(every.groupBy("node").agg(F.sum("total").alias("total")))


def depth(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """The largest distance from any node without incoming edges."""
    roots = degrees(simple_edges(edges), nodes, node).filter("in_degree = 0").select(node)
    return shortest_paths(edges, roots, node).agg(F.coalesce(F.max("distance"), F.lit(0)).alias("depth"))


def _trimmed(links: DataFrame) -> DataFrame:
    """Edges between nodes that have both incoming and outgoing ones, until none goes."""
    size = None
    while size != (now := links.count()):
        size = now
        entered, left = links.select(F.col("target").alias("source")).distinct(), links.select(F.col("source").alias("target")).distinct()
        before, links = links, written(links.join(entered, "source", "left_semi").join(left, "target", "left_semi"))
        forget(before)
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """node and colour of every node that is not trimmed away, alike within a strongly connected component.

    Each node takes the smallest node that reaches it as its colour; what reaches that node within
    the colour is its component.  Components found go, and the rest is coloured anew.
    """
    start = links
    links = _trimmed(written(links))
    found = []
    while not links.isEmpty():
        nodes = links.select(F.col("source").alias("node")).union(links.select("target")).distinct()
        colours = written(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        changed = True
        while changed:
            # a node that kept its colour has sent it before
            sent = links.join(colours.filter("moved"), F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("sent"))
            step = written(colours.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), F.coalesce(F.col("sent") < F.col("colour"), F.lit(False)).alias("moved")))
            changed = not step.filter("moved").isEmpty()
            forget(colours)
            colours = step
        ends = [colours.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour")) for side in ("source", "target")]
        inner = written(links.join(ends[0], "source").join(ends[1], "target").filter("source_colour = target_colour").select("source", "target"))
        front = marked = written(colours.filter("node = colour").select("node", "colour"))
        while not front.isEmpty():
            sources = inner.join(front, F.col("target") == F.col("node")).select(F.col("source").alias("node"), "colour").distinct()
            before, front = (front, marked), written(sources.join(marked, "node", "left_anti"))
            marked = written(marked.unionByName(front))
            forget(*{id(x): x for x in before}.values())
        found.append(marked)
        gone = marked.select("node")
        rest = links.join(gone, F.col("source") == F.col("node"), "left_anti").join(gone, F.col("target") == F.col("node"), "left_anti")
        links = _trimmed(written(rest))
    every = found[0] if found else start.limit(0).select(F.col("source").alias("node"), F.col("source").alias("colour"))
    for part in found[1:]:
        every = every.unionByName(part)
    return every


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of nodes with one edge in and one out: node, head and tail (the nodes around the chain), and node and least of closed rings, which have neither.

    Both ends are found by doubling, so rounds grow with the logarithm of the longest chain.
    """
    into = links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("before")).filter("n = 1")
    out = links.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("after")).filter("n = 1")
    state = written(into.join(out.drop("n"), "node").select("node", "before", "after", F.col("node").alias("least")))
    for _ in range(state.count().bit_length() + 1):
        on = state.select(F.col("node").alias("after"), F.col("after").alias("_after"), F.col("least").alias("_least"))
        back = state.select(F.col("node").alias("before"), F.col("before").alias("_before"))
        step = state.join(on, "after", "left").join(back, "before", "left")
        step = written(step.select("node", F.coalesce("_before", "before").alias("before"), F.coalesce("_after", "after").alias("after"), F.least("least", F.coalesce("_least", "least")).alias("least"), (F.col("_after").isNotNull() | F.col("_before").isNotNull()).alias("moved")))
        forget(state)
        state = step
        if state.filter("moved").isEmpty():
            break
    inner = state.select(F.col("node").alias("after"), F.lit(True).alias("_ring"))
    marked = state.join(inner, "after", "left")
    return marked.filter("_ring is null").select("node", F.col("before").alias("head"), F.col("after").alias("tail")), marked.filter("_ring").select("node", "least")


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges between numbers, and name and id of each node: numbers are shuffled and sorted faster than names."""
    ends = links.select(F.col("source").alias("name")).union(links.select("target")).distinct()
    names = written(ends.withColumn("id", F.monotonically_increasing_id()))
    sides = [names.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id")) for side in ("source", "target")]
    return links.join(sides[0], "source").join(sides[1], "target").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), names


def strong_components(edges: DataFrame, node: str = "node") -> DataFrame:
    """node and component (its smallest node) of strongly connected components of two nodes and more.

    Chains are taken for one edge each, and rings found, by doubling; what is left is coloured.
    Each round is joins over the edges; reachability of all pairs is never made.  Rounds of
    colouring grow with the longest path of what is left.
    """
    links = written(simple_edges(edges))
    chains, rings = (written(t) for t in _chains(links))
    through = chains.select("node").unionByName(rings.select("node"))
    between = links.join(through, F.col("source") == F.col("node"), "left_anti").join(through, F.col("target") == F.col("node"), "left_anti")
    over = chains.select(F.col("head").alias("source"), F.col("tail").alias("target"))
    short = written(between.unionByName(over).distinct())
    numbers, names = _numbered(short.filter("source <> target"))
    named = [names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("node", "colour")]
    marked = _coloured(numbers).join(named[0], "node").join(named[1], "colour")
    colours = written(marked.select(F.col("node_name").alias("node"), F.col("colour_name").alias("colour")))
    ends = [colours.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour")) for side in ("head", "tail")]
    # a chain lies in a component if both of its ends do, or if it leads back to where it starts
    inside = chains.join(ends[0], "head", "left").join(ends[1], "tail", "left").filter("head = tail or head_colour = tail_colour")
    within = inside.select("node", F.coalesce("head_colour", "head").alias("colour"))
    looped = inside.filter("head = tail and head_colour is null").select(F.col("head").alias("node"), F.col("head").alias("colour")).distinct()
    every = colours.unionByName(within).unionByName(looped)
    # of a component with its own chains the smallest node names it
    named = every.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    found = every.join(named, "colour").select(F.col("node").alias(node), "component")
    return found.unionByName(rings.select(F.col("node").alias(node), F.col("least").alias("component")))


def simple_cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """length and number of simple cycles up to a length, each counted from its smallest node.

    The number of cycles grows exponentially with their length, so the length is a parameter.
    """
    links = written(simple_edges(edges))
    paths = links.filter("source < target").select(F.array("source", "target").alias("path"))
    counts = None
    for k in range(2, longest + 1):
        ends = paths.select(F.col("path")[0].alias("target"), F.element_at("path", -1).alias("source"))
        closed = ends.join(links, ["source", "target"]).agg(F.lit(k).alias("length"), F.count("*").alias("cycles"))
        counts = closed if counts is None else counts.unionByName(closed)
        if k < longest:
            grown = paths.join(links, F.element_at("path", -1) == F.col("source"))
            paths = written(grown.filter((F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target"))).select(F.array_append("path", F.col("target")).alias("path")))
    return counts


def induced(edges: DataFrame, keep: DataFrame, node: str = "node") -> DataFrame:
    """Edges between kept nodes."""
    ids = keep.select(F.col(node).alias("_id"))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")


def neighbourhood(edges: DataFrame, focus: DataFrame, node: str = "node") -> DataFrame:
    """Edges that touch a focus node."""
    ids = focus.select(F.col(node).alias("_id")).distinct()
    marked = edges.join(ids, F.col("source") == F.col("_id"), "left").withColumnRenamed("_id", "_s").join(ids, F.col("target") == F.col("_id"), "left")
    return marked.filter("_s is not null or _id is not null").drop("_s", "_id")


def least_degree(edges: DataFrame, least: int, neighbours: bool = False) -> DataFrame:
    """Edges between (or, with neighbours, at) nodes of at least so many edges."""
    ends = both_ways(edges).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree")).filter(F.col("degree") >= least)
    return neighbourhood(edges, ends) if neighbours else induced(edges, ends)
