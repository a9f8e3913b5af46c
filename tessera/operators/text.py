"""Per-file text operators: metrics and rule issues, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims


def admit(files: DataFrame) -> DataFrame:
    """Normalised paths of known languages outside ignored places, with ``language``."""
    named = files.withColumn("path", C.normal_path(F.col("path"))).filter(~C.is_ignored(F.col("path"))).withColumn("language", C.language(F.col("path")))
    return named.filter("language <> 'unknown'")


def file_metrics(files: DataFrame) -> DataFrame:
    """``loc``, ``comments``, ``blank``, ``sloc`` of ``files(path, language, content)``; a trailing newline adds a line."""
    content = F.coalesce(F.col("content"), F.lit(""))
    counted = files.select(
        *[c for c in files.columns if c != "content"],
        F.size(C.lines(content)).alias("loc"),
        C.comment_count(content, F.col("language")).alias("comments"),
        F.size(F.filter(C.lines(content), lambda x: C.trimmed(x) == "")).alias("blank"),
    )
    return counted.withColumn("sloc", F.greatest(F.lit(0), F.col("loc") - F.col("comments") - F.col("blank")))


def _is_comment(line: Column, lang: Column) -> Column:
    t = C.trimmed(line)
    return F.when(lang == "python", t.startswith("#")).otherwise(t.startswith("//") | t.startswith("*") | t.startswith("/*"))


def _in_string(before: Column) -> Column:
    """Whether an odd number of one kind of quote that no backslash precedes stands before a place."""
    odd = [F.regexp_count(before, F.lit(rf"(?<!\\){q}")) % 2 == 1 for q in ("'", '"', "`")]
    return odd[0] | odd[1] | odd[2]


def issues(files: DataFrame) -> DataFrame:
    """``(path, line, rule, category, severity, message, snippet)``: each rule's first match in each line.

    The rules are literals of one array expression, so a line meets them without a join or a shuffle.
    """
    at = files.select("path", "language", F.posexplode(C.lines(F.coalesce(F.col("content"), F.lit("")))).alias("i", "text"))
    group = F.when(F.col("language").isin(dims.JS_LIKE), F.lit("js")).otherwise(F.col("language"))
    flagged = at.select("path", "i", "text", group.alias("grp"), _is_comment(F.col("text"), F.col("language")).alias("comment"))
    checks = []
    for pos, (lang, rule, category, severity, message, pattern) in enumerate(dims.RULES):
        applies = F.lit(True) if lang == "any" else F.col("grp") == lang
        if category not in ("todo", "smell"):
            applies = applies & ~F.col("comment")
        hit = F.regexp_instr(F.col("text"), F.lit(pattern))
        found = applies & F.col("text").rlike(pattern)
        if category != "todo":
            found = found & ~_in_string(F.substring(F.col("text"), F.lit(1), hit - 1))
        checks.append(F.when(found, F.struct(F.lit(pos).alias("pos"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))))
    kept = flagged.select("path", "i", "text", F.explode(F.array_compact(F.array(*checks))).alias("r"))
    return kept.select("path", (F.col("i") + 1).alias("line"), "r.rule", "r.category", "r.severity", "r.message", F.left(C.trimmed(F.col("text")), F.lit(100)).alias("snippet"), F.col("r.pos").alias("rule_pos"))
