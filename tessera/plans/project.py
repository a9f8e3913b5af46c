"""A project's analysis as DataFrames, and the questions that tools ask of it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dims
from tessera.functions.session import reachable
from tessera.operators import build, domains, export, graph, history, parse, resolve, summary, text, viz
from tessera.sources import files as file_source
from tessera.sources import gitlog, projectconfig


@dataclass
class AnalyzeOptions:
    name: str = "project"
    config: resolve.ResolverConfig | None = None
    commits: DataFrame | None = None
    commit_times: DataFrame | None = None
    coupling: DataFrame | None = None
    max_symbols: int | None = dims.MAX_SYMBOL_NODES


@dataclass
class Project:
    """Tables of one analysed project; methods answer with DataFrames."""

    spark: SparkSession
    raw: DataFrame
    options: AnalyzeOptions = field(default_factory=AnalyzeOptions)
    analyzed_at: str = ""

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str) -> Project:
        raw, _ = file_source.discover(spark, root)
        commits, times = gitlog.read_history(spark, root)
        known = history.known_only(commits, raw)
        return cls(spark, raw, AnalyzeOptions(Path(root).resolve().name, projectconfig.read_config(root), known, times)).analyze()

    @property
    def name(self) -> str:
        return self.options.name

    def analyze(self) -> Project:
        """Build all tables; the parsed files are kept, the rest is lazy until asked for."""
        reachable(self.spark)
        o = self.options
        self.analyzed_at = datetime.now(UTC).isoformat()
        admitted = text.admit(self.raw.select("path", "content"))
        self.parsed = parse.parse(admitted).persist()
        self.issues = text.issues(admitted).persist()
        self.symbols = self.parsed.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", "pos", "s.*")
        found = self.parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*")
        paths = self.parsed.select("path")
        self.imports = resolve.resolve_imports(found, paths, o.config).persist()
        metrics = text.file_metrics(admitted).select("path", "language", "loc", "sloc", "comments")
        counted = self.issues.groupBy("path").agg(F.count(F.lit(1)).alias("issues"))
        own = self.parsed.select("path", "complexity", "doc_coverage", "parse_error", "exports", F.size("symbols").alias("n_symbols"))
        self.files = metrics.join(own, "path").join(counted, "path", "left").withColumn("issues", F.coalesce("issues", F.lit(0))).persist()
        internal = self.imports.filter("resolved is not null").select(F.col("path").alias("source"), F.col("resolved").alias("target"))
        components = graph.strong_components(internal)
        self.cycles = graph.cycles(components)
        grouped = domains.by_imports(paths.withColumn("project", F.lit(o.name)), internal.withColumn("project", F.lit(o.name))).select("path", "domain").persist()
        self.domains = domains.disambiguate(domains.labels(grouped)).persist()
        self.members = grouped.join(self.domains.select("domain", "id"), "domain").select("path", F.col("id").alias("domain")).persist()
        self.stats = history.churn(o.commits) if o.commits is not None else None
        self.nodes, edges = build.build(self.files, self.symbols, self.imports, self.members, self.domains, graph.circular_edges(internal, components), self.stats, o.max_symbols)
        pairs = o.coupling if o.coupling is not None else (history.coupling(o.commits) if o.commits is not None else None)
        self.pairs = pairs
        self.edges = (build.add_coupling(edges, pairs, paths) if pairs is not None else edges.withColumns({"weight": F.lit(None).cast("double"), "hidden": F.lit(None).cast("boolean")})).persist()
        return self

    def refresh(self) -> Project:
        for df in (self.parsed, self.issues, self.imports, self.files, self.domains, self.members, self.edges):
            df.unpersist()
        return self.analyze()

    def register(self, prefix: str = "") -> None:
        """Temporary views of the tables, for SQL."""
        for name in ("files", "imports", "symbols", "issues", "nodes", "edges", "domains", "members", "cycles"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    # -------------------------------------------------------- questions

    @property
    def internal(self) -> DataFrame:
        return self.edges.filter("type = 'imports' and target not like 'ext:%'").select("source", "target")

    def overview(self, detail: str = "compact", max_tokens: int | None = None) -> str:
        return export.code_map(self, detail, max_tokens)

    def list_files(self, domain: str | None = None) -> DataFrame:
        labels = self.members.join(self.domains.select(F.col("id").alias("domain"), "label"), "domain")
        out = self.files.join(labels, "path", "left").select("path", "language", F.col("label").alias("domain"), "loc", "complexity", "issues")
        return (out if domain is None else out.filter(F.col("domain") == domain)).orderBy("path")

    def list_domains(self) -> DataFrame:
        return domains.detail(self.members, self.files, self.internal).join(self.domains.select(F.col("id").alias("domain"), "label"), "domain")

    def domain_detail(self, name: str) -> DataFrame:
        """By label or id; the larger domain if both match."""
        return self.list_domains().filter((F.col("label") == name) | (F.col("domain") == name)).orderBy(F.desc("files")).limit(1)

    def describe_file(self, path: str) -> DataFrame:
        """One nested row, or none."""
        one = self.files.filter(F.col("path") == path)
        child = lambda df, name: df.filter(F.col("path") == path).groupBy("path").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "path"])).alias(name))
        uses = self.dependencies_of(path).agg(F.array_sort(F.collect_list("target")).alias("imports"))
        used = self.dependents_of(path).agg(F.array_sort(F.collect_list("source")).alias("imported_by"))
        return one.join(child(self.symbols, "symbols"), "path", "left").join(child(self.issues, "issue_list"), "path", "left").join(self.members, "path", "left").join(uses).join(used)

    def dependencies_of(self, path: str) -> DataFrame:
        return graph.dependencies_of(self.internal, path).orderBy("target")

    def dependents_of(self, path: str) -> DataFrame:
        return graph.dependents_of(self.internal, path).orderBy("source")

    def impact_of(self, path: str) -> DataFrame:
        return graph.impact_of(self.internal, path).orderBy("node")

    def find_symbol(self, name: str) -> DataFrame:
        """Symbols whose last name part matches in any case, with the files that call it by its exact name."""
        last = F.element_at(F.split("name", r"\."), -1)
        hits = self.symbols.filter(F.lower(last) == name.lower()).select("id", "name", "kind", "path", "line", "exported", last.alias("simple"))
        calls = self.symbols.select(F.col("path").alias("caller"), F.explode("calls").alias("simple")).distinct()
        found = hits.join(calls, "simple").filter("caller <> path").groupBy("id").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
        return hits.join(found, "id", "left").withColumn("called_by", F.coalesce("called_by", F.lit([]).cast("array<string>"))).drop("simple")

    def callers_of(self, symbol: str) -> DataFrame:
        return self.edges.filter((F.col("type") == "calls") & (F.col("target") == symbol)).select("source")

    def callees_of(self, symbol: str) -> DataFrame:
        return self.edges.filter((F.col("type") == "calls") & (F.col("source") == symbol)).select("target")

    def hotspots(self) -> DataFrame:
        if self.stats is None:
            return self.spark.createDataFrame([], "path string, score double, complexity int, commits long")
        return history.hotspots(self.files.select("path", "complexity"), self.stats)

    def temporal_coupling(self) -> DataFrame:
        if self.pairs is None:
            return self.spark.createDataFrame([], "a string, b string, shared long, coupling double")
        return history.hidden_coupling(self.pairs, self.internal, self.files)

    def partners_of(self, path: str) -> DataFrame:
        """Files that change with a file."""
        e = self.edges.filter("type = 'co-change'")
        return e.filter((F.col("source") == path) | (F.col("target") == path)).select(F.when(F.col("source") == path, F.col("target")).otherwise(F.col("source")).alias("path"), "weight", "hidden")

    def circular_dependencies(self) -> DataFrame:
        return self.cycles

    def search(self, query: str) -> DataFrame:
        return viz.search(self.files.select("path", "language", "loc"), query).orderBy("path")

    def timeline(self) -> tuple[DataFrame, DataFrame]:
        """Commits per bucket and the activity of each file."""
        return history.commits_per_bucket(self.options.commit_times), history.activity(self.options.commits, self.options.commit_times)

    def health_inputs(self) -> DataFrame:
        t = summary.totals(self.files, self.symbols, self.issues)
        f = self.files.agg(F.sum((F.col("loc") > dims.BIG_FILE_LOC).cast("int")).alias("big_files"), F.sum((F.col("n_symbols") > 0).cast("int")).alias("documented"), F.avg(F.when(F.col("n_symbols") > 0, F.col("doc_coverage"))).alias("doc_ratio"))
        e = self.issues.agg(F.coalesce(F.sum((F.col("severity") == "error").cast("long")), F.lit(0)).alias("errors"))
        return t.join(f).join(e).join(self.cycles.agg(F.count(F.lit(1)).alias("cycles")))

    def summary_row(self) -> dict:
        """The summary as one dictionary; every part of it is bounded but for the entry points."""
        inputs = self.health_inputs()
        row = inputs.first().asDict()
        h = summary.health(inputs).first()
        counts = {r["severity"]: r["n"] for r in summary.by_severity(self.issues).collect()}
        return row | counts | {
            "circular_deps": row["cycles"], "score": h["score"], "grade": h["grade"], "factors": [f.asDict() for f in h["factors"]],
            "files_by_language": {r["label"]: r["n"] for r in summary.by_language(self.files).collect()},
            "entry_points": [r["path"] for r in summary.entry_points(self.files).orderBy("path").collect()],
            "stack": sorted(r["technology"] for r in summary.stack(self.files, self.imports).collect()),
        }

    def write(self, out: str) -> None:
        """Tables as Parquet, graph as JSON lines, summary and code map as documents."""
        for name in ("files", "imports", "symbols", "issues", "nodes", "edges", "domains", "members", "cycles"):
            getattr(self, name).write.mode("overwrite").parquet(f"{out}/{name}")
        export.write_graph(self.nodes, self.edges, f"{out}/graph")
        Path(out, "CODEMAP.md").write_text(self.overview("normal"), encoding="utf-8")
        Path(out, "summary.json").write_text(json.dumps(self.summary_row(), ensure_ascii=False), encoding="utf-8")


def snapshot_point(project: Project, sha: str, date: str, subject: str) -> dict:
    """One point of a history series: the summary's numbers and the largest eight domains."""
    s = project.summary_row()
    top = project.domains.orderBy(F.desc("size"), "id").limit(8).collect()
    return {"sha": sha, "date": date, "subject": subject, "files": s["total_files"], "loc": s["total_loc"], "symbols": s["total_symbols"], "avg_complexity": s["avg_complexity"], "health": s["score"], "grade": s["grade"], "issues": s["total_issues"], "circular_deps": s["circular_deps"], "domains": [{"label": d["label"], "files": d["size"]} for d in top]}


def snapshots(spark: SparkSession, root: str, points: int = 20) -> list[dict] | None:
    """Re-analyses of evenly picked commits of the first-parent history, each in a work tree of its own."""
    import tempfile

    log = gitlog.run_git(root, ["log", "--first-parent", "--reverse", "--format=%H%x1f%aI%x1f%s"])
    commits = [line.split(gitlog.US) for line in (log or "").splitlines() if line]
    if len(commits) < 2:
        return None
    n, last = max(2, min(60, points)), len(commits) - 1
    picked = sorted({i if len(commits) <= n else int(i * last / (n - 1) + 0.5) for i in range(min(n, len(commits)))})
    out = []
    for i in picked:
        sha, date, subject = commits[i]
        with tempfile.TemporaryDirectory() as folder:
            tree = f"{folder}/tree"
            if gitlog.run_git(root, ["worktree", "add", "--detach", tree, sha]) is None:
                continue
            try:
                raw, _ = file_source.discover(spark, tree)
                out.append(snapshot_point(Project(spark, raw, AnalyzeOptions(Path(root).name, projectconfig.read_config(tree))).analyze(), sha, date, subject))
            finally:
                gitlog.run_git(root, ["worktree", "remove", "--force", tree])
    return out if len(out) > 1 else None


def read_snapshots(spark: SparkSession, location: str) -> DataFrame:
    """A stored series, one row a point."""
    return spark.read.option("multiLine", True).json(location)
