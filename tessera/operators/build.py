"""The multi-relation graph of a project: node and edge tables from files, symbols, imports, domains and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims
from tessera.operators import history, summary
from tessera.operators.resolve import resolve_calls

NODE_COLUMNS = ["id", "type", "label", "path", "language", "loc", "complexity", "issues", "domain", "risk", "churn", "hotspot", "kind", "file", "exported", "file_count", "color"]


def _edges(df: DataFrame, kind: str) -> DataFrame:
    """Edges of a type once each; an edge to itself is dropped."""
    plain = df.filter("source <> target").select("source", "target").distinct()
    return plain.select(F.concat(F.lit(f"{kind}:"), "source", F.lit("→"), "target").alias("id"), "source", "target", F.lit(kind).alias("type"))


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, members: DataFrame, domains: DataFrame, circular: DataFrame, stats: DataFrame | None = None, max_symbols: int | None = dims.MAX_SYMBOL_NODES) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``. ``files(path, language, loc, complexity, issues)``, ``symbols(path, pos, id, name, kind, exported,
    calls)``, ``imports(path, specifier, kind, resolved)``, ``members(path, domain)`` with domain ids. The symbol plane is
    left out when there are more than ``max_symbols``."""
    own = files.join(members.select("path", "domain"), "path", "left")
    if stats is not None:
        own = own.join(stats.select("path", "commits"), "path", "left")
        most = stats.join(files.select("path"), "path", "left_semi").agg(F.max("commits").alias("most"))
        own = own.join(F.broadcast(most)).withColumn("hotspot", F.when(F.col("commits").isNotNull(), history.hotspot_score(F.col("complexity"), F.col("commits"), F.col("most"))))
    else:
        own = own.withColumn("commits", F.lit(None).cast("long")).withColumn("hotspot", F.lit(None).cast("double"))
    file_nodes = own.select(F.col("path").alias("id"), F.lit("file").alias("type"), C.basename(F.col("path")).alias("label"), "path", "language", "loc", "complexity", "issues", "domain", summary.risk(F.col("complexity"), F.col("issues")).alias("risk"), F.col("commits").alias("churn"), "hotspot")
    domain_nodes = domains.select("id", F.lit("domain").alias("type"), "label", F.col("size").alias("file_count"), "color")
    planes = [file_nodes, domain_nodes]
    relations = [_edges(members.select(F.col("path").alias("source"), F.col("domain").alias("target")), "member-of")]
    if max_symbols is None or symbols.count() <= max_symbols:
        planes.append(symbols.select("id", F.lit("symbol").alias("type"), F.col("name").alias("label"), "kind", F.col("path").alias("file"), "exported"))
        relations.append(_edges(symbols.select(F.col("path").alias("source"), F.col("id").alias("target")), "contains"))
        relations.append(_edges(resolve_calls(symbols), "calls"))
    outside = imports.filter("resolved is null and kind = 'external'").select(F.concat(F.lit("ext:"), "specifier").alias("id"), F.lit("external").alias("type"), F.col("specifier").alias("label")).distinct()
    planes.append(outside)
    target = F.coalesce("resolved", F.when(F.col("kind") == "external", F.concat(F.lit("ext:"), "specifier")))
    relations.append(_edges(imports.select(F.col("path").alias("source"), target.alias("target")).filter("target is not null"), "imports"))
    nodes = planes[0]
    for p in planes[1:]:
        nodes = nodes.unionByName(p, allowMissingColumns=True)
    edges = relations[0]
    for r in relations[1:]:
        edges = edges.unionByName(r)
    marks = circular.select("source", "target", F.lit("imports").alias("type"), F.lit(True).alias("circular")).distinct()
    edges = edges.join(marks, ["source", "target", "type"], "left").select("id", "source", "target", "type", "circular")
    return nodes.select(*[c for c in NODE_COLUMNS if c in nodes.columns]), edges


def add_coupling(edges: DataFrame, pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` with a co-change edge for each pair of existing files, its weight and whether no import joins the two."""
    marked = history.mark_hidden(pairs, edges.filter("type = 'imports'"), files)
    more = marked.select(F.concat(F.lit("co-change:"), "a", F.lit("↔"), "b").alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), F.lit("co-change").alias("type"), F.col("coupling").alias("weight"), "hidden")
    return edges.unionByName(more, allowMissingColumns=True)
