"""Communities of files: by folder, or by modularity over the undirected import graph; labels and colours."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dims


def by_directory(files: DataFrame) -> DataFrame:
    """``(path, domain)``: the first path segment; a segment with a dot is the root."""
    first = F.substring_index("path", "/", 1)
    return files.select("path", F.when(F.contains(first, F.lit(".")), F.lit(dims.ROOT_LABEL)).otherwise(first).alias("domain"))


def labels(members: DataFrame) -> DataFrame:
    """``(domain, label)`` of ``members(domain, path)``: the commonest nearest specific parent folder if two fifths of the
    files have it, else the commonest specific folder, else the first segment. Ties go to what comes first in path order."""
    generic = F.array(*[F.lit(g) for g in dims.GENERIC_SEGMENTS])
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    specific = F.filter(folders, lambda s: ~F.array_contains(generic, s))
    base = members.select("domain", "path", specific.alias("s"))
    size = base.groupBy("domain").agg(F.count(F.lit(1)).alias("size"))

    def top(votes: DataFrame, name: str) -> DataFrame:
        counted = votes.groupBy("domain", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "i")).alias("first"))
        return counted.groupBy("domain").agg(F.min(F.struct((-F.col("n")).alias("minus"), "first", "seg")).alias("t")).select("domain", F.col("t.seg").alias(name), (-F.col("t.minus")).alias(f"{name}_n"))

    parents = top(base.filter(F.size("s") > 0).select("domain", "path", F.lit(0).alias("i"), F.element_at("s", -1).alias("seg")), "parent")
    every = top(base.select("domain", "path", F.posexplode("s").alias("i", "seg")), "folder")
    heads = top(base.select("domain", "path", F.lit(0).alias("i"), F.substring_index("path", "/", 1).alias("seg")), "head")
    joined = size.join(parents, "domain", "left").join(every, "domain", "left").join(heads, "domain", "left")
    root = F.when(F.col("head").isNull() | (F.col("head") == "") | F.contains("head", F.lit(".")), F.lit(dims.ROOT_LABEL)).otherwise(F.col("head"))
    return joined.select("domain", F.when(F.col("parent_n") >= F.col("size") * 0.4, F.col("parent")).otherwise(F.coalesce("folder", root)).alias("label"), "size")


def disambiguate(named: DataFrame) -> DataFrame:
    """``label``, ``id`` and ``color`` of domains in order of size: a repeated label gets its number."""
    order = [F.desc("size"), F.col("domain")]
    rank = F.row_number().over(Window.orderBy(*order)) - 1  # one row a domain
    nth = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    out = named.select("domain", "size", "label", rank.alias("rank"), nth.alias("nth"))
    label = F.when(F.col("nth") > 1, F.concat("label", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    palette = F.array(*[F.lit(c) for c in dims.PALETTE])
    return out.select("domain", "size", label.alias("label"), F.concat(F.lit("domain:"), label).alias("id"), F.element_at(palette, (F.col("rank") % len(dims.PALETTE) + 1).cast("int")).alias("color"))


def modularity_groups(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Greedy local moving and folding at resolution 1 over sorted nodes: deterministic, every node in one group."""
    weight: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    index = {n: i for i, n in enumerate(nodes)}
    for a, b in edges:
        weight[index[a]][index[b]] += 1.0
        weight[index[b]][index[a]] += 1.0
    of = list(range(len(nodes)))
    while True:
        ids = sorted(weight)  # nodes without edges stay alone
        total = sum(sum(w.values()) for w in weight.values())
        if not total:
            break
        k = {i: sum(weight[i].values()) for i in ids}
        group, volume = {i: i for i in ids}, dict(k)
        moved = True
        while moved:
            moved = False
            for i in ids:
                near: dict[int, float] = defaultdict(float)
                for j, w in weight[i].items():
                    if j != i:
                        near[group[j]] += w
                own = group[i]
                volume[own] -= k[i]
                gain = {g: w - volume[g] * k[i] / total for g, w in near.items()}
                best = min(gain, key=lambda g: (-gain[g], g), default=own)
                if gain.get(best, 0.0) <= gain.get(own, -volume[own] * k[i] / total) + 1e-12:
                    best = own
                volume[best] += k[i]
                if best != own:
                    group[i] = best
                    moved = True
        if all(group[i] == i for i in ids):
            break
        of = [group.get(g, g) for g in of]
        folded: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for i, row in weight.items():
            for j, w in row.items():
                folded[group[i]][group[j]] += w
        weight = folded
    return {n: of[i] for n, i in index.items()}


def _folder(path: str) -> list[str]:
    return [p for p in path.split("/")[:-1] if p]


def absorb_singles(groups: list[list[str]]) -> list[list[str]]:
    """Each group of one joins the larger group whose common folder is the longest one above it (else the first).

    Groups are looked up by folder, so the work grows with the paths, not with the groups times the groups of one.
    """
    large = [g for g in groups if len(g) > 1]
    if not large:
        return groups
    common = []
    for g in large:
        parts = [_folder(p) for p in g]
        first, last = min(parts), max(parts)  # what these two share, all share
        n = 0
        while n < min(len(first), len(last)) and first[n] == last[n]:
            n += 1
        common.append(first[:n])
    below: dict[tuple[str, ...], list[int]] = defaultdict(list)  # folder to the groups whose common folder is it or below it
    for i, c in enumerate(common):
        for d in range(1, len(c) + 1):
            below[tuple(c[:d])].append(i)  # in ascending order, so each list is a heap
    for (single,) in [g for g in groups if len(g) == 1]:
        own, best, depth = _folder(single), 0, 0
        for d in range(len(own), 0, -1):
            near = below.get(tuple(own[:d]), [])
            while near and len(common[near[0]]) < d:  # the group's common folder has moved up since
                heapq.heappop(near)
            if near:
                best, depth = near[0], d
                break
        large[best].append(single)
        common[best] = own[:depth]
    return large


def by_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``(project, path, domain)`` by communities of each project's import graph; one task a project, as its graph has
    a node a file. Projects without internal imports fall back to folders. ``files(project, path)``,
    ``imports(project, source, target)``."""

    def groups(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(set(left["path"]))
        known = set(paths)
        edges = [(a, b) for a, b in zip(right["source"], right["target"], strict=True) if a in known and b in known and a != b]
        if not edges:
            named = [(p, dims.ROOT_LABEL if "." in p.split("/")[0] else p.split("/")[0]) for p in paths]
        else:
            found = modularity_groups(paths, edges)
            by: dict[int, list[str]] = defaultdict(list)
            for p in paths:
                by[found[p]].append(p)
            named = [(p, f"{i:06d}") for i, g in enumerate(absorb_singles(sorted(by.values(), key=lambda g: (-len(g), g[0])))) for p in g]
        return pd.DataFrame([(left["project"].iloc[0], p, d) for p, d in named], columns=["project", "path", "domain"])

    known = imports.select("project", "source", "target").join(files.select("project").distinct(), "project", "left_semi")
    return files.select("project", "path").groupBy("project").cogroup(known.groupBy("project")).applyInPandas(groups, "project string, path string, domain string")


def detail(members: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """Per domain: files, loc and the other domains that it imports (an unknown target counts as its own)."""
    m = members.select("domain", "path")
    sizes = m.join(files.select("path", "loc"), "path", "left").groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    out = imports.join(m.withColumnRenamed("path", "source"), "source").join(m.select(F.col("path").alias("target"), F.col("domain").alias("to")), "target", "left")
    uses = out.select("domain", F.coalesce("to", "target").alias("to")).filter("to <> domain").groupBy("domain").agg(F.array_sort(F.collect_set("to")).alias("depends_on"))
    return sizes.join(uses, "domain", "left").select("domain", "files", "loc", F.coalesce("depends_on", F.lit([]).cast("array<string>")).alias("depends_on"))
