"""The tables of a run as inputs of the operators: commit rows, edges and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files made of parts that one task reads: a second or two of parsing.
PARTS_A_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str):
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: each touches the brands of its parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), millis("o_orderdate").alias("ts"), F.col("p_brand").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("removed"))


def brand_pair_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commits without their headers: what pairs need."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sha"), F.col("p_brand").alias("path"))


def supplier_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("path"))


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a commit of its user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sha"), F.col("user_id").alias("path"), F.col("event_type"), millis("ts").alias("ts"))


def follow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse edges from a line's part to the next line's part, for small quantities."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = l.filter("l_quantity <= 3").select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("source"))
    b = l.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("target"))
    return a.join(b, ["l_orderkey", "n"]).filter("source <> target").select("source", "target").distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a part, with several cycles."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return p.join(F.broadcast(n)).select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * F.col("p_size") % F.col("n") + 1).alias("target")).filter("source <> target")


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).filter("source <> target").distinct()


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files in folders of their source and language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scripts, for the rules of scripting languages."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.col("html").alias("content"))


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files ``(path, content)``: even keys are JavaScript, odd ones Python. Each imports the next of its kind (the
    last one the first) and a package, and has one function, documented where the size is even, which calls the next file's.

    The files are far larger than the rows that they are made of, which come in one split, so the rows are dealt out first."""
    rows = table(spark, sf_dir, "part")
    part = rows.repartition(-(-rows.count() // PARTS_A_TASK) or 1, "p_partkey").select("p_partkey", F.col("p_size").cast("string").alias("s"), (F.col("p_size") % 2 == 0).alias("even"))
    top = part.agg(F.max("p_partkey").alias("top"))
    k, n = F.col("p_partkey"), F.when(F.col("p_partkey") + 2 <= F.col("top"), F.col("p_partkey") + 2).otherwise(F.col("p_partkey") % 2).cast("string")
    script = F.concat(
        F.lit("import { f"), n, F.lit(" } from './m"), n, F.lit("';\nimport tool from 'tool"), (F.col("p_partkey") % 7).cast("string"), F.lit("';\n"), F.when(F.col("even"), "/** Says how. */\n").otherwise(""),
        F.lit("export function f"), k.cast("string"), F.lit("(a) {\n  if (a > "), F.col("s"), F.lit(") {\n    return f"), n, F.lit("(a);\n  }\n  return a;\n}\n"),
    )
    python = F.concat(
        F.lit("import os\nfrom .m"), n, F.lit(" import g"), n, F.lit("\n\n\ndef g"), k.cast("string"), F.lit("(a):\n"), F.when(F.col("even"), '    """Says how."""\n').otherwise(""),
        F.lit("    if a > "), F.col("s"), F.lit(" and a:\n        return g"), n, F.lit("(a)\n    return a\n"),
    )
    odd = k % 2 == 1
    return part.join(F.broadcast(top)).select(F.concat(F.when(odd, "py/m").otherwise("web/m"), k.cast("string"), F.when(odd, ".py").otherwise(".js")).alias("path"), F.when(odd, python).otherwise(script).alias("content"))
