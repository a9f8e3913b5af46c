"""Project summaries: totals, languages, entry points, stack and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims


def risk(complexity: Column, issues: Column) -> Column:
    return C.round_half_up(0.55 * C.clamp01(complexity / 50.0) + 0.45 * C.clamp01(issues / 10.0), 2)


def totals(files: DataFrame, symbols: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, loc, symbols, issues and the mean complexity to one digit."""
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), F.coalesce(C.round_half_up(F.avg("complexity"), 1), F.lit(0.0)).alias("avg_complexity"))
    return f.join(symbols.agg(F.count(F.lit(1)).alias("total_symbols"))).join(issues.agg(F.count(F.lit(1)).alias("total_issues")))


def by_severity(issues: DataFrame) -> DataFrame:
    """``(severity, n)``, always the three severities."""
    every = issues.sparkSession.createDataFrame([(s,) for s in ("info", "warning", "error")], "severity string")
    return every.join(issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy(C.language_label(F.col("language")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def entry_points(files: DataFrame) -> DataFrame:
    return files.select("path").filter(C.basename(F.col("path")).isin(dims.ENTRY_NAMES))


def stack(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct technologies that file names, import specifiers and languages reveal. Patterns are literals of one
    array, so no join is needed; labels are few before they are exchanged."""
    name, path = F.lower(C.basename(F.col("path"))), F.col("path")
    named = [F.when(name.rlike(p) | path.rlike(p), F.lit(label)) for p, label in dims.STACK_FILES]
    base = [F.when(F.col("language").isin("typescript", "tsx"), F.lit("TypeScript")), F.when(F.col("language") == "python", F.lit("Python"))]
    bare = F.regexp_replace("specifier", "^@types/", "")
    used = [F.when(bare.rlike(p), F.lit(label)) for p, label in dims.STACK_IMPORTS]
    one = files.select(F.explode(F.array_compact(F.array(*named, *base))).alias("technology"))
    two = imports.select(F.explode(F.array_compact(F.array(*used))).alias("technology"))
    return one.unionByName(two).distinct()


def external_packages(imports: DataFrame) -> DataFrame:
    return imports.filter("kind = 'external' and resolved is null").select("specifier").distinct()


def health(inputs: DataFrame) -> DataFrame:
    """``score``, ``grade`` and ``factors`` of one-row inputs (cycles, avg_complexity, errors, big_files, documented, doc_ratio).

    ``documented`` counts files with symbols; ``doc_ratio`` is the mean of their coverage.
    """
    c = {n: F.col(n) for n in ("cycles", "avg_complexity", "errors", "big_files", "documented", "doc_ratio")}
    raw = [
        ("Dependencias circulares", F.when(c["cycles"] > 0, F.greatest(F.lit(-30.0), -8.0 * c["cycles"])), F.concat(c["cycles"].cast("string"), F.lit(" ciclo(s) detectado(s)"))),
        ("Complejidad alta", F.when(c["avg_complexity"] > 10, F.greatest(F.lit(-20.0), -(c["avg_complexity"] - 10) * 1.5)), F.concat(F.lit("Complejidad promedio "), c["avg_complexity"].cast("string"))),
        ("Issues graves", F.when(c["errors"] > 0, F.greatest(F.lit(-25.0), -2.0 * c["errors"])), F.concat(c["errors"].cast("string"), F.lit(' issue(s) de severidad "error"'))),
        ("Archivos gigantes", F.when(c["big_files"] > 0, F.greatest(F.lit(-15.0), -2.0 * c["big_files"])), F.concat(c["big_files"].cast("string"), F.lit(" archivo(s) > 600 líneas"))),
        ("Poca documentación", F.when((c["documented"] >= 5) & (c["doc_ratio"] < 25), F.lit(-10.0)), F.concat(F.lit("Solo "), C.round_half_up(c["doc_ratio"]).cast("int").cast("string"), F.lit("% de símbolos documentados"))),
    ]
    factors = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), C.round_half_up(impact, 1).alias("impact"), text.alias("detail")) for label, impact, text in raw]), lambda f: f["impact"] < 0)
    lost = F.aggregate(factors, F.lit(0.0), lambda a, f: a + f["impact"])
    score = F.greatest(F.lit(0.0), C.round_half_up(100.0 + lost)).cast("int")
    s = inputs.select(factors.alias("factors"), score.alias("score"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 55, "D").otherwise("F")
    return s.select("score", grade.alias("grade"), "factors")
