"""Source files of a folder as ``(path, content)`` rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims


def is_within_root(root: str | Path, path: str | Path) -> bool:
    """Whether a path, links followed, stays inside the root."""
    top, own = Path(root).resolve(), Path(path).resolve()
    return own == top or top in own.parents


def valid_root(root: str | Path) -> Path:
    p = Path(root)
    if not p.is_dir():
        raise ValueError(f"Invalid rootDir: {root}")
    return p.resolve()


def discover(spark: SparkSession, root: str, max_bytes: int = dims.MAX_FILE_CHARS) -> tuple[DataFrame, DataFrame]:
    """``files(path, content)`` and ``skipped(path, length)`` of too large ones.

    The folder is listed on the driver, where hidden and ignored folders are never entered and links are left out;
    executors read the contents. Names and sizes are pruned before any content is read.
    """
    top = valid_root(root)
    kept, large = [], []
    stack = [top]
    while stack:
        for p in sorted(stack.pop().iterdir()):
            if p.is_symlink():
                continue
            if p.is_dir():
                if not p.name.startswith(".") and p.name not in dims.IGNORE_DIRS:
                    stack.append(p)
            elif p.is_file() and p.name.rpartition(".")[0] and p.suffix[1:].lower() in dims.EXTENSIONS and is_within_root(top, p):
                size = p.stat().st_size
                (large if size > max_bytes else kept).append((str(p.relative_to(top)), size))
    empty = spark.createDataFrame([], "path string, content string")
    skipped = spark.createDataFrame(large, "path string, length long")
    if not kept:
        return empty, skipped
    raw = spark.read.format("binaryFile").load([f"file://{top / rel}" for rel, _ in kept])
    rel = F.substr(F.regexp_replace(F.col("path"), "^file:/*", "/"), F.lit(len(str(top)) + 2))
    return raw.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.decode("content", "UTF-8").alias("content")), skipped


def read_tree(spark: SparkSession, location: str, max_bytes: int = dims.MAX_FILE_CHARS) -> DataFrame:
    """``(path, content)`` of a tree in any store that Spark reads; sizes and names prune before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
    rel = F.regexp_replace(F.col("path"), "^.*?" + location.rstrip("/").split(":")[-1].replace(".", r"\.") + "/", "")
    named = raw.filter(F.col("length") <= max_bytes).withColumn("path", rel).filter(~C.is_ignored(F.col("path")) & (C.language(F.col("path")) != "unknown"))
    return named.select("path", F.decode("content", "UTF-8").alias("content"))


def limited(files: DataFrame, most: int = 4000) -> tuple[DataFrame, bool]:
    """The first ``most`` files by path and whether there were more (the limit of interactive folders)."""
    return files.orderBy("path").limit(most), files.count() > most
