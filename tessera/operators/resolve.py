"""Imports to files and calls to symbols, as joins over ordered candidates.

Each import makes a short ordered array of candidate keys; one join with the file keys and the smallest priority decide. What a
script's specifier may lack isn't spelt out by each import: the file offers the shorter keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C

# Fixed orders of what a specifier may lack.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".css", ".scss"]
BUILT_ENDINGS = [".js", ".jsx", ".mjs", ".cjs"]
JAVA_ROOTS = ["src/main/java/", "src/test/java/", "src/main/kotlin/", "src/", "app/src/main/java/"]
BUILT_TO_SOURCE = [("dist/", "src/"), ("dist/", "lib/"), ("build/", "src/")]


@dataclass
class Workspace:
    name: str
    dir: str
    entry: str | None = None
    exports: dict[str, str] = field(default_factory=dict)


@dataclass
class ResolverConfig:
    """Aliases ``(from, to, wildcard)``, workspaces by name, a base folder and a Go module; all are a project's few settings."""

    base_url: str | None = None
    aliases: list[tuple[str, str, bool]] = field(default_factory=list)
    workspaces: list[Workspace] = field(default_factory=list)
    go_module: str | None = None


def _tries(base: Column) -> list[Column]:
    """A path as it is, then all that it may lack at once: files are keyed by what their endings leave, see ``file_keys``."""
    return [base, F.concat(F.lit("try:"), base)]


def _with_stripped(base: Column) -> list[Column]:
    stripped = F.regexp_replace(base, r"\.(?:js|jsx|mjs|cjs)$", "")
    return [*_tries(base), *[F.when(base.rlike(r"\.(?:js|jsx|mjs|cjs)$"), t) for t in _tries(stripped)]]


def _script(spec: Column, path: Column, config: ResolverConfig) -> Column:
    relative = spec.startswith(".")
    out = [F.when(relative, t) for t in _with_stripped(C.fold_path(F.concat_ws("/", C.dirname(path), spec)))]
    free = ~relative
    for source, target, wild in sorted(config.aliases, key=lambda a: -len(a[0])):
        hit = spec.startswith(source) if wild else spec == source
        base = C.fold_path(F.concat(F.lit(target), F.substr(spec, F.lit(len(source) + 1))) if wild else F.lit(target))
        out += [F.when(free & hit, t) for t in _with_stripped(base)]
    for w in config.workspaces:
        whole, inner = spec == w.name, spec.startswith(w.name + "/")
        if w.entry:
            entry = C.fold_path(F.lit(f"{w.dir}/{w.entry}"))
            out.append(F.when(whole, entry))
        for folder in (f"{w.dir}/index", f"{w.dir}/src/index"):
            out += [F.when(whole, t) for t in _tries(C.fold_path(F.lit(folder)))]
        for sub, target in w.exports.items():
            mapped = [target, *[target.replace(a, b, 1) for a, b in BUILT_TO_SOURCE if a in target]]
            for m in mapped:
                out += [F.when(spec == f"{w.name}/{sub.removeprefix('./')}", t) for t in _with_stripped(C.fold_path(F.lit(f"{w.dir}/{m}")))]
        rest = F.substr(spec, F.lit(len(w.name) + 2))
        for folder in (w.dir, f"{w.dir}/src"):
            out += [F.when(inner, t) for t in _with_stripped(C.fold_path(F.concat(F.lit(folder + "/"), rest)))]
    if config.base_url is not None:
        claimed = F.lit(False)
        for w in config.workspaces:
            claimed = claimed | (spec == w.name) | spec.startswith(w.name + "/")
        out += [F.when(free & ~claimed, t) for t in _with_stripped(C.fold_path(F.concat(F.lit(config.base_url + "/"), spec)))]
    return F.array(*out)


def _python(spec: Column, path: Column) -> Column:
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    up = F.repeat(F.lit("../"), dots - 1)
    rest = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = C.fold_path(F.concat(C.dirname(path), F.lit("/"), up, rest))
    near = [F.when(dots > 0, F.concat(base, F.lit(".py"))), F.when(dots > 0, F.when(base == "", F.lit("__init__.py")).otherwise(F.concat(base, F.lit("/__init__.py"))))]
    far = [F.when(dots == 0, F.concat(F.lit("py:"), spec)), F.when(dots == 0, F.concat(F.lit("py:"), F.substring_index(spec, ".", 1)))]
    return F.array(*near, *far)


def _rust(spec: Column, path: Column) -> Column:
    """``mod::x`` is a sibling; else the longest to the shortest prefix below the crate, the parent or the file's folder."""
    parts = F.split(F.regexp_replace(spec, r"^(?:crate|self|super|mod)::", ""), "::")
    crate = F.when(path.startswith("src/") | F.contains(path, F.lit("/src/")), F.concat(F.regexp_extract(path, r"^(.*?)(?:^|/)?src/", 1), F.when(path.startswith("src/"), F.lit("src")).otherwise(F.lit("/src")))).otherwise(F.lit("."))
    stem = F.when(C.basename(path).isin("mod.rs", "lib.rs", "main.rs"), C.dirname(path)).otherwise(F.regexp_replace(path, r"\.rs$", ""))
    root = F.when(spec.startswith("mod::"), C.dirname(path)).when(spec.startswith("self::"), stem).when(spec.startswith("super::"), C.dirname(stem)).otherwise(crate)
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: C.fold_path(F.concat(root, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))
    return F.flatten(F.transform(prefixes, lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))))


def file_keys(files: DataFrame, config: ResolverConfig) -> DataFrame:
    """``(key, rank, target)``: what candidates may name a file by: its path, the path without its ending or as a folder's
    index, a Python module, a Java class, a Go package. ``rank`` is the place of the ending, with those of an index after all others."""
    path = F.col("path")
    ending = F.concat(F.lit("."), F.substring_index(path, ".", -1))
    rank = F.array_position(F.array(*[F.lit(e) for e in SCRIPT_ENDINGS]), ending).cast("int")
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(ending))
    index = F.when(stem.endswith("/index"), F.struct(F.substr(stem, F.lit(1), F.length(stem) - 6).alias("stem"), (rank + len(SCRIPT_ENDINGS)).alias("rank")))
    script = files.filter(F.contains(path, F.lit(".")) & (rank > 0)).select(path.alias("target"), F.explode(F.array(F.struct(stem.alias("stem"), rank.alias("rank")), index)).alias("k")).filter("k is not null")
    script = script.select(F.concat(F.lit("try:"), "k.stem").alias("key"), "k.rank", "target")
    plain = files.select(path.alias("key"), path.alias("target"))
    module = F.replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))
    py = files.filter(path.rlike(r"\.pyi?$")).select(path, F.explode(F.array(module, F.when(F.contains(module, F.lit(".")), F.regexp_replace(module, r"^[^.]*\.", "")))).alias("m")).filter("m is not null")
    python = py.groupBy(F.concat(F.lit("py:"), "m").alias("key")).agg(F.max("path").alias("target"))  # later files overwrite earlier ones
    bare = F.coalesce(*[F.when(path.startswith(r), F.substr(path, F.lit(len(r) + 1))) for r in JAVA_ROOTS], path)
    java = files.filter(path.endswith(".java")).groupBy(F.concat(F.lit("java:"), F.replace(F.regexp_replace(bare, r"\.java$", ""), F.lit("/"), F.lit("."))).alias("key")).agg(F.max("path").alias("target"))
    folder = C.dirname(path)
    main = F.when(C.basename(path) == F.concat(C.basename(folder), F.lit(".go")), 0).when(~path.endswith("_test.go"), 1).otherwise(2)
    go = files.filter(path.endswith(".go")).groupBy(F.concat(F.lit("go:"), folder).alias("key")).agg(F.min(F.struct(main.alias("r"), "path")).alias("m")).select("key", F.col("m.path").alias("target"))
    return plain.unionByName(python).unionByName(java).unionByName(go).select("key", F.lit(0).alias("rank"), "target").unionByName(script)


def resolve_imports(imports: DataFrame, files: DataFrame, config: ResolverConfig | None = None) -> DataFrame:
    """``imports(path, pos, specifier, kind, line)`` with ``resolved`` and the kind that follows from it."""
    config = config or ResolverConfig()
    spec, path = F.col("specifier"), F.col("path")
    module = config.go_module
    go = F.array(F.when(spec == module, F.lit("go:")), F.when(spec.startswith(f"{module}/"), F.concat(F.lit("go:"), F.substr(spec, F.lit(len(module) + 2))))) if module else F.lit([]).cast("array<string>")
    candidates = (
        F.when(path.endswith(".py"), _python(spec, path))
        .when(path.endswith(".java"), F.array(F.concat(F.lit("java:"), spec)))
        .when(path.endswith(".go"), go)
        .when(path.endswith(".rs"), _rust(spec, path))
        .otherwise(_script(spec, path, config))
    )
    tried = imports.select("path", "pos", F.posexplode(candidates).alias("prio", "key")).filter("key is not null")
    hit = tried.join(file_keys(files, config), "key").groupBy("path", "pos").agg(F.min_by("target", F.struct("prio", "rank")).alias("resolved"))
    joined = imports.drop("resolved").join(hit, ["path", "pos"], "left")
    return joined.withColumn("kind", F.when(F.col("resolved").isNotNull(), F.lit("internal")).otherwise(F.col("kind")))


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """Edges ``(source, target)`` between symbols ``(path, pos, id, name, calls)``: the last symbol of that name in the same
    file, else the only one anywhere; ambiguous names and calls of oneself are dropped."""
    named = symbols.select("path", "pos", "id", "calls", F.element_at(F.split("name", r"\."), -1).alias("simple"))
    calls = named.select("path", F.col("id").alias("source"), F.explode("calls").alias("simple"))
    local = named.groupBy("path", "simple").agg(F.max_by("id", "pos").alias("own"))
    single = named.groupBy("simple").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).filter("n = 1").select("simple", "only")
    both = calls.join(local, ["path", "simple"], "left").join(single, "simple", "left")
    target = F.when(F.col("own").isNotNull() & (F.col("own") != F.col("source")), F.col("own")).otherwise(F.col("only"))
    return both.select("source", target.alias("target")).filter("target is not null and source <> target").distinct()
