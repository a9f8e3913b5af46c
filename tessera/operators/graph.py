"""Graph operators over edge tables ``(source, target)``: degree, neighbours, closure, strong components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import cut


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree of each node."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def dependencies_of(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("source") == F.lit(node)).select("target").distinct()


def dependents_of(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("target") == F.lit(node)).select("source").distinct()


def impact_of(edges: DataFrame, node) -> DataFrame:
    """All nodes that reach ``node`` (itself left out): a breadth-first frontier joined with the edges until it is empty."""
    reverse = edges.select("source", "target").distinct()
    frontier = cut(reverse.filter(F.col("target") == F.lit(node)).select(F.col("source").alias("node")).filter(F.col("node") != F.lit(node)).distinct())
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(reverse, F.col("node") == F.col("target")).select(F.col("source").alias("n")).distinct().filter(F.col("n") != F.lit(node))
        frontier = cut(step.join(seen, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node")))
        seen = cut(seen.unionByName(frontier))
    return seen


SMALL_EDGES = 200_000


def tarjan(edges: list[tuple]) -> dict:
    """Node to the smallest node of its strong component, for components of more than one node; no recursion."""
    out: dict = {}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order, low, on, stack = {}, {}, set(), []
    for root in sorted(after):
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    if len(part) > 1:
                        out |= dict.fromkeys(part, min(part))
    return out


def _small_components(edges: DataFrame) -> DataFrame:
    """Strong components of an edge table whose size was checked, in one task."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches):
        rows = [pair for b in batches for pair in zip(b["source"].tolist(), b["target"].tolist(), strict=True)]
        found = tarjan(rows)
        if found:
            yield pd.DataFrame({"node": list(found), "component": list(found.values())})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of trimming and contraction: ``(edges left, merged)``, for edges without loops and repetitions.

    Edges from a node without edges in, or to one without edges out, are on no cycle. A node ``u`` whose only edge goes to ``v``
    is in the component of ``v`` or in none: its edges move to ``v``. Coins of the turn see to it that ``v`` itself stays, so
    a quarter of such nodes go at once. ``merged(x, u, v)`` keeps the edges ``x`` to ``u``, which decide later.
    """
    coin = lambda c: F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("to"))
    out = out.select("source", F.when((F.col("n") == 1) & coin("source") & ~coin("to"), F.col("to")).alias("via"))
    met = edges.select(F.col("target").alias("source")).distinct()
    kept = edges.join(out, "source").filter("via is null").drop("via").join(met, "source", "left_semi")
    moved = cut(kept.join(out.withColumnRenamed("source", "target"), "target").select("source", "target", "via"))
    merged = moved.filter("via is not null").select(F.col("source").alias("x"), F.col("target").alias("u"), F.col("via").alias("v"))
    left = moved.select("source", F.coalesce("via", "target").alias("target")).filter("source <> target").distinct()
    return cut(left), merged


def _expand(found: DataFrame, merged: DataFrame) -> DataFrame:
    """``found(node, component)`` with the nodes of one contraction: ``u`` is in the component of ``v`` if an edge comes from there."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    known = merged.join(of("x"), "x", "left").join(of("v"), "v", "left")
    name = F.coalesce("of_v", "v")
    back = known.filter(F.coalesce("of_x", "x") == name)
    more = back.select(F.explode(F.array(F.struct(F.col("u").alias("node"), name.alias("component")), F.struct(F.col("v").alias("node"), name.alias("component")))).alias("m")).select("m.*")
    return cut(found.unionByName(more).distinct())


def _colour(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of colouring: ``(edges left, found(node, component))``. Each node takes the largest node that reaches it as
    its colour; walking back from that node inside its colour gives its component."""
    colour = left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node"))
    colour, changed = cut(colour), True
    while changed:
        pushed = left.join(colour, F.col("source") == F.col("node")).groupBy("target").agg(F.max("colour").alias("via"))
        new = cut(colour.join(pushed, F.col("node") == F.col("target"), "left").select("node", F.greatest("colour", F.coalesce("via", "colour")).alias("colour"), (F.col("via") > F.col("colour")).alias("moved")))
        changed = not new.filter("moved").isEmpty()
        colour = new.drop("moved")
    inside = cut(left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("ct")), "target").filter("cs = ct").select("source", "target", F.col("cs").alias("colour")))
    reached = cut(colour.filter("node = colour"))
    frontier = reached
    while not frontier.isEmpty():
        step = inside.join(frontier.select(F.col("node").alias("target"), "colour"), ["target", "colour"])
        frontier = cut(step.select(F.col("source").alias("node"), "colour").distinct().join(reached, ["node", "colour"], "left_anti"))
        reached = cut(reached.unionByName(frontier))
    done = reached.select("node")
    rest = cut(left.join(done, F.col("source") == F.col("node"), "left_anti").join(done, F.col("target") == F.col("node"), "left_anti"))
    sizes = reached.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rest, cut(reached.join(sizes, "colour").select("node", F.col("colour").alias("component")))


def _parts(left: DataFrame, small: int) -> DataFrame:
    """``(node, component)`` of edges without loops and repetitions, each component named by one of its nodes."""
    size, turn, idle, back, levels = left.count(), 0, 0, False, []
    while size > small and idle < 2:
        source, target = ("target", "source") if back else ("source", "target")
        left, merged = _contract(left.select(F.col(source).alias("source"), F.col(target).alias("target")), turn)
        left = left.select(F.col(source).alias("source"), F.col(target).alias("target"))
        levels.append(merged)
        now = left.count()
        idle, back = (0, back) if now < 0.9 * size else (idle + 1, not back)
        size, turn = now, turn + 1
    if size <= small:
        found = cut(_small_components(left))
    else:
        rest, found = _colour(left)
        found = cut(found.unionByName(_parts(rest, small)))
    for merged in reversed(levels):
        found = _expand(found, merged)
    return found


def strong_components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """``(node, component)`` of the strongly connected components of more than one node; the component is its smallest node.

    A table of at most ``small`` edges is done in one task. A larger one is contracted until it is small: nodes with one edge out
    (or, on the reversed edges, in) go into their neighbour, so long chains and cycles take rounds by the logarithm of their
    length. Where two rounds take away less than a tenth, a round of colouring (Orzan, 2004) takes whole components out of
    what is left. Every step is a join or an aggregate.
    """
    left = cut(edges.select("source", "target").filter("source <> target").distinct())
    if left.count() <= small:
        return _small_components(left)
    found = _parts(left, small)
    named = found.groupBy("component").agg(F.min("node").alias("name"))
    return found.join(named, "component").select("node", F.col("name").alias("component"))


def cycles(components: DataFrame) -> DataFrame:
    """``(cycle_id, members, size)``."""
    return components.groupBy(F.col("component").alias("cycle_id")).agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))


def circular_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside one strong component."""
    s = components.select(F.col("node").alias("source"), F.col("component").alias("cs"))
    t = components.select(F.col("node").alias("target"), F.col("component").alias("ct"))
    return edges.select("source", "target").distinct().join(s, "source").join(t, "target").filter("cs = ct").select("source", "target")
