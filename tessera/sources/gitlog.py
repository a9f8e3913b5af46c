"""Commit rows from a captured log or from a repository."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dims

RS, US = "\x1e", "\x1f"
FORMAT = "%x1e%H%x1f%an%x1f%aI"


def run_git(root: str, args: list[str]) -> str | None:
    """Output of git, or None where it fails."""
    done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else None


def parse_log(records: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Commit rows and headers ``(sha, author, date, ts)`` of log records: a header of separated fields, then numstat lines.

    Records are rows of one text column ``value`` (read with the record separator as line separator). Commits whose date
    can't be read are skipped; binary files count no lines.
    """
    rows = records.filter(F.length(F.trim("value")) > 0).select(F.split("value", "\n").alias("l"))
    head = F.split(F.get("l", F.lit(0)), US)
    parsed = rows.select(F.get(head, F.lit(0)).alias("sha"), F.get(head, F.lit(1)).alias("author"), F.get(head, F.lit(2)).alias("date"), F.slice("l", 2, F.size("l")).alias("l"))
    dated = parsed.withColumn("ts", (F.unix_micros(F.try_to_timestamp("date")) / 1000).cast("long")).filter("ts is not null and ts <> 0")
    lines = dated.select("sha", "author", "date", "ts", F.explode("l").alias("line"))
    number = r"^([0-9]+|-)\t([0-9]+|-)\t(.+)$"
    path = F.trim(F.regexp_extract("line", number, 3))
    found = lines.filter(F.col("line").rlike(number)).select("sha", "author", "date", "ts", path.alias("path"), *[F.coalesce(F.expr(f"try_cast(regexp_extract(line, '^([0-9]+|-)\\\\t([0-9]+|-)', {i}) as bigint)"), F.lit(0)).alias(n) for i, n in ((1, "added"), (2, "removed"))])
    if prefix:
        found = found.filter(F.col("path").startswith(prefix)).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))
    return found, dated.select("sha", "author", "date", "ts")


def read_log(spark: SparkSession, location: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """A captured log, split by record separators as Spark reads it."""
    return parse_log(spark.read.option("lineSep", RS).text(location), prefix)


def read_history(spark: SparkSession, root: str, most: int = dims.MAX_COMMITS) -> tuple[DataFrame, DataFrame]:
    """History of the repository that holds ``root``; paths relative to it. Elsewhere, no rows."""
    top = run_git(root, ["rev-parse", "--show-toplevel"])
    raw = run_git(root, ["log", "--numstat", "--no-renames", "--no-merges", f"-n{most}", f"--format={FORMAT}"]) if top else None
    inside = "" if not top else str(Path(root).resolve().relative_to(Path(top.strip()).resolve()))
    records = spark.createDataFrame([(r,) for r in (raw or "").split(RS) if r.strip()], "value string")
    return parse_log(records, "" if inside in ("", ".") else inside + "/")
