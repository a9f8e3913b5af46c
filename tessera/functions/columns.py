"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dims


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity (Spark's ``round`` goes away from zero)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; names whose only dot leads have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def language_label(lang: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in dims.LABELS.items() for x in pair]), lang)


def is_ignored(path: Column) -> Column:
    """An ignored file name, or an ignored folder anywhere above the file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return basename(path).isin(dims.IGNORE_FILES) | F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dims.IGNORE_DIRS]))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def fold_path(path: Column) -> Column:
    """Drops empty and ``.`` parts and lets ``..`` take the part before it (a no-op at the root)."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.lit([]).cast("array<string>"),
            lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
        ),
        "/",
    )


def trimmed(line: Column) -> Column:
    """Trims all Unicode white space."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def comment_count(content: Column, lang: Column) -> Column:
    """Comment lines by a state machine over the lines: an aggregate of (in a block, count), no UDF."""
    start = F.struct(F.lit(False).alias("block"), F.lit(0).alias("n"))

    def python(acc: Column, raw: Column) -> Column:
        odd = F.regexp_count(raw, F.lit("\"\"\"|'''")) % 2 == 1
        inside = acc["block"]
        return F.struct((inside != odd).alias("block"), (acc["n"] + (inside | odd | trimmed(raw).startswith("#")).cast("int")).alias("n"))

    def c_like(acc: Column, raw: Column) -> Column:
        line = trimmed(raw)
        inside, closes, opens = acc["block"], F.contains(line, F.lit("*/")), line.startswith("/*")
        block = F.when(inside, ~closes).otherwise(opens & ~closes)
        return F.struct(block.alias("block"), (acc["n"] + (inside | opens | line.startswith("//") | line.startswith("*")).cast("int")).alias("n"))

    return F.when(lang == "python", F.aggregate(lines(content), start, python, lambda a: a["n"])).otherwise(F.aggregate(lines(content), start, c_like, lambda a: a["n"]))
