"""Projections of the graph for people and exports: slim graphs, search, display graphs, section budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import degree

SLIM_EDGES = ["imports", "member-of", "co-change"]


def search(files: DataFrame, text: str, column: str = "path") -> DataFrame:
    """Rows whose column holds the text, whatever the case."""
    return files.filter(F.contains(F.lower(F.col(column)), F.lower(F.lit(text))))


def palette_search(domains: DataFrame, files: DataFrame, text: str, top: int = 40) -> DataFrame:
    """Domains, then files, whose label or subtitle holds the text; the first ``top`` of them."""
    d = domains.select(F.lit(0).alias("kind"), "label", F.col("id").alias("sub"))
    f = files.select(F.lit(1).alias("kind"), F.substring_index("path", "/", -1).alias("label"), F.col("path").alias("sub"))
    both = d.unionByName(f)
    return both.filter(F.contains(F.lower("label"), F.lower(F.lit(text))) | F.contains(F.lower("sub"), F.lower(F.lit(text)))).orderBy("kind", "sub").limit(top)


def slim_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin("file", "domain"))


def slim_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type").isin(SLIM_EDGES))


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.7))


def within_budget(sections: DataFrame, budget: int | None, spent: int) -> DataFrame:
    """Sections in order of (rank, pos) until the first that would exceed the budget; the first one always stays.
    Sections are a dozen rows, so one ordered window is right."""
    if budget is None:
        return sections
    order = Window.orderBy("rank", "pos")
    used = F.sum(tokens(F.col("text")) + 2).over(order) + F.lit(spent)
    marked = sections.withColumn("__i", F.row_number().over(order)).withColumn("__over", (used > budget) & (F.col("__i") > 1))
    stopped = F.max(F.col("__over").cast("int")).over(order)
    return marked.withColumn("__stop", stopped).filter("__stop = 0").drop("__i", "__over", "__stop")


def display_graph(nodes: DataFrame, edges: DataFrame, mode: str = "files", domain: str | None = None, externals: bool = False, coupling: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree and links between visible nodes. A domain hides externals; lone documents, JSON files and
    externals are dropped."""
    kinds = ["file"] + (["symbol"] if mode == "symbols" else []) + (["external"] if externals and domain is None else [])
    shown = nodes.filter(F.col("type").isin(kinds))
    if domain is not None:
        inside = nodes.filter((F.col("type") == "file") & (F.col("domain") == domain)).select("id")
        shown = shown.join(inside.withColumnRenamed("id", "own"), (F.col("id") == F.col("own")) | (F.col("file") == F.col("own")), "left_semi")
    types = ["imports"] + (["contains", "calls"] if mode == "symbols" else []) + (["co-change"] if coupling else [])
    ids = shown.select("id")
    links = edges.filter(F.col("type").isin(types)).join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    counted = shown.join(degree(links), F.col("id") == F.col("node"), "left").drop("node").withColumn("degree", F.coalesce("degree", F.lit(0)))
    lone = (F.col("degree") == 0) & ((F.col("type") == "external") | F.coalesce(F.col("language").isin("markdown", "json"), F.lit(False)))
    return counted.filter(~lone), links


def node_radius(kind: Column, degree_: Column, loc: Column) -> Column:
    """A display size that grows with the square root of lines and degree."""
    return F.when(kind == "external", F.lit(4.0)).when(kind == "symbol", F.lit(3.0)).otherwise(F.least(F.lit(22.0), 4 + F.sqrt(F.coalesce(loc, F.lit(0)).cast("double")) / 4 + F.sqrt(degree_.cast("double"))))


def alive_at(activity: DataFrame, bucket: int, buckets: int = 48) -> DataFrame:
    """``born`` and ``just_changed`` of files at a bucket; unknown files are born in the last one."""
    first = F.coalesce("first_bucket", F.lit(buckets - 1))
    return activity.select("path", (first <= bucket).alias("born"), (F.coalesce(F.get("activity", F.lit(bucket)), F.lit(0)) > 0).alias("just_changed"))
