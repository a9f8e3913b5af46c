"""The operators on small fixtures: history, graph, text, parsing, resolving, the whole project."""

import random
import subprocess
import time
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import domains, export, graph, history, parse, resolve, summary, text, viz
from tessera.plans import adapters, catalog, samples
from tessera.plans.project import AnalyzeOptions, Project
from tessera.sources import files as file_source
from tessera.sources import gitlog, projectconfig


def commits(spark, rows):
    return spark.createDataFrame([(s, a, d, t, p, x, y) for s, a, d, t, p, x, y in rows], "sha string, author string, date string, ts long, path string, added long, removed long")


def test_churn_and_coupling(spark):
    rows = [(f"c{i}", f"u{i % 2}", f"2024-01-0{i + 1}", i, p, 2, 1) for i in range(6) for p in (("a", "b") if i < 5 else ("a",))]
    rows += [("big", "u", "2024-02-01", 9, f"f{i}", 1, 0) for i in range(26)]
    df = commits(spark, rows)
    stats = {r["path"]: r for r in history.churn(df).collect()}
    assert (stats["a"]["commits"], stats["a"]["authors"], stats["a"]["lines_changed"], stats["a"]["first_commit"]) == (6, 2, 18, "2024-01-01")
    assert [tuple(r) for r in history.coupling(df).collect()] == [("a", "b", 5, 1.0)]
    pairs = history.coupling(df)
    none = spark.createDataFrame([], "source string, target string")
    assert history.hidden_coupling(pairs, none).count() == 1
    assert history.hidden_coupling(pairs, spark.createDataFrame([("b", "a")], "source string, target string")).count() == 0
    assert history.hidden_coupling(pairs, none, spark.createDataFrame([("a",)], "path string")).count() == 0


def test_repeated_paths_in_a_commit_count_towards_the_gate(spark):
    df = commits(spark, [("c", "u", "d", 1, "a", 1, 1), ("c", "u", "d", 1, "a", 1, 1)])
    assert history.pair_counts(df).count() == 0


def test_many_commits_are_dealt_out_by_their_number(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(60)}", f"p{rng.randrange(40)}") for _ in range(400)] + [("big", f"p{i}") for i in range(26)] + [("c1", None)]
    monkeypatch.setattr(history, "MANY_COMMIT_ROWS", 100, raising=False)
    monkeypatch.setattr(history, "COMMIT_ROWS_A_TASK", 50, raising=False)
    got = history.pair_counts(spark.createDataFrame(rows, "sha string, path string"))
    by, want = {}, Counter()
    for sha, path in rows:
        by.setdefault(sha, []).append(path)
    for paths in by.values():
        if 2 <= len(paths) <= 25:
            want.update(combinations(sorted({p for p in paths if p}), 2))
    assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 9  # 427 rows, 50 a task


def test_timeline_sums_to_commits(spark):
    times = spark.createDataFrame([(i * 37 % 1000,) for i in range(200)], "ts long")
    per = history.commits_per_bucket(times).collect()
    assert len(per) == 48 and sum(r["n"] for r in per) == 200
    one = spark.createDataFrame([(5, "a"), (5, "b")], "ts long, path string")
    rows = {r["path"]: r for r in history.activity(one, one).collect()}
    assert rows["a"]["first_bucket"] == 0 and sum(rows["a"]["activity"]) == 1 and len(rows["a"]["activity"]) == 48


def test_pick_evenly_keeps_both_ends(spark):
    got = sorted(r["id"] for r in history.pick_evenly(spark.range(101), "id", 5).collect())
    assert got == [0, 25, 50, 75, 100]
    assert sorted(r["id"] for r in history.pick_evenly(spark.range(4), "id", 20).collect()) == [0, 1, 2, 3]


def test_pick_evenly_is_exact_over_many_range_partitions(spark, tmp_path):
    rng = random.Random(5)
    spark.range(600_000, numPartitions=3).select((F.col("id") * 7919 % 600_000).alias("k"), (F.col("id") % 97).alias("v")).write.parquet(str(tmp_path / "t"))
    items = spark.read.parquet(str(tmp_path / "t"))
    want = [int(i * 599_999 / 19 + 0.5) for i in range(20)]
    assert sorted(r["k"] for r in history.pick_evenly(items, "k", 20).collect()) == want
    points = history.pick_evenly(items, "k", 20).select("k", F.col("k").alias("at"))
    moments = spark.createDataFrame([(m,) for m in rng.sample(range(600_000), 50)], "ts long")
    for r in history.nearest(points, moments, "at", "ts", "k").collect():
        assert (r["gap"], r["nearest_pos"]) == min((abs(w - r["ts"]), w) for w in want)


def test_points_without_a_moment_are_never_the_nearest(spark):
    points = spark.createDataFrame([(1, None), (2, 10)], "pos long, at long")
    assert [tuple(r) for r in history.nearest(points, spark.createDataFrame([(7,)], "ts long"), "at", "ts", "pos").collect()] == [(7, 2, 10, 3)]
    assert [r["id"] for r in history.pick_evenly(spark.createDataFrame([(None,), (1,), (2,)], "id long"), "id", 2).orderBy("id").collect()] == [None, 1]


def test_hotspot_and_risk(spark):
    files = spark.createDataFrame([("hot", 40), ("calm", 1)], "path string, complexity int")
    stats = spark.createDataFrame([("hot", 40), ("calm", 1)], "path string, commits long")
    assert [(r["path"], r["score"]) for r in history.hotspots(files, stats).collect()][0] == ("hot", 1.0)
    assert spark.range(1).select(summary.risk(F.lit(50), F.lit(10)).alias("r")).first()["r"] == 1.0


@pytest.mark.parametrize("small", [0, 10**6])
def test_strong_components_against_brute_force(spark, small):
    rng = random.Random(3)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)]
    reach = {a: {b for x, b in edges if x == a} for a in range(14)}
    for _ in range(14):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in reach if any(a in reach[b] and b != a for b in reach[a])}
    got = graph.strong_components(spark.createDataFrame(edges, "source long, target long"), small)
    assert {r["node"]: r["component"] for r in got.collect()} == want


def _cuts(monkeypatch, most):
    """Lets the graph operators make ``most`` intermediate tables."""
    made, real = [], graph.cut

    def counted(df):
        made.append(1)
        assert len(made) <= most, "a round for each step of a path"
        return real(df)

    monkeypatch.setattr(graph, "cut", counted)


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    ring = [(i, (i + 1) % 600) for i in range(600)]
    tail = [(1000 + i, 1001 + i) for i in range(400)] + [(1400, 7)]
    _cuts(monkeypatch, 100)
    got = graph.strong_components(spark.createDataFrame(ring + tail, "source long, target long"), 50)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(600)}


def test_contracted_components_are_those_of_tarjan(spark, monkeypatch):
    rng = random.Random(8)
    ring = [(f"r{i}", f"r{(i + 1) % 90}") for i in range(90)]
    fan = [(f"n{rng.randrange(120)}", f"n{i}") for i in range(120)]  # one edge in each
    map_ = [(f"m{i}", f"m{rng.randrange(120)}") for i in range(120)]  # one edge out each
    edges = sorted({(a, b) for a, b in [*ring, *fan, *map_, ("r5", "n1"), ("m3", "r7"), ("r8", "r3")] if a != b})
    _cuts(monkeypatch, 100)
    got = graph.cycles(graph.strong_components(spark.createDataFrame(edges, "source string, target string"), 20)).collect()
    want = {}
    for node, component in graph.tarjan(edges).items():
        want.setdefault(component, []).append(node)
    assert {r["cycle_id"]: (r["members"], r["size"]) for r in got} == {c: (sorted(m), len(m)) for c, m in want.items()}


def test_no_components_and_no_files(spark):
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    assert graph.strong_components(e).count() == 0 and graph.strong_components(e, 0).count() == 0 and graph.strong_components(e.limit(0)).count() == 0
    files = spark.createDataFrame([("p", "a/x.py"), ("p", "b.c/y.py")], "project string, path string")
    imports = spark.createDataFrame([("q", "a", "b")], "project string, source string, target string")
    assert sorted(r["domain"] for r in domains.by_imports(files, imports).collect()) == ["a", "raíz"]


def test_closure_leaves_out_its_start(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "source string, target string")
    assert sorted(r["node"] for r in graph.impact_of(e, "c").collect()) == ["a", "b", "d"]
    assert [r["target"] for r in graph.dependencies_of(e, "a").collect()] == ["b"]


def test_comment_counting_and_metrics(spark):
    rows = [
        ("a.js", "javascript", "/* x\n y */\n// z\ncode\n"), ("b.py", "python", '"""doc\n\nend"""\n# c\nx = 1'), ("c.md", "markdown", "* bullet\ntext"), ("d.js", "javascript", ""), ("e.js", "javascript", None),
    ]
    m = {r["path"]: r for r in text.file_metrics(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert (m["a.js"]["loc"], m["a.js"]["comments"], m["a.js"]["blank"], m["a.js"]["sloc"]) == (5, 3, 1, 1)
    assert m["b.py"]["comments"] == 4 and m["c.md"]["comments"] == 1 and m["d.js"]["loc"] == 1 and m["e.js"]["loc"] == 1


def test_rules(spark):
    lines = ["x// TODO now", " // TODO no", "console.log(1)", "// console.log(1)", "s = 'eval('", "eval(x); eval(y)", "var a = 1", "a == b", "let q: any = 1"]
    df = spark.createDataFrame([("a.ts", "typescript", "\n".join(lines))], "path string, language string, content string")
    got = sorted((r["line"], r["rule"]) for r in text.issues(df).collect())
    assert got == [(1, "todo"), (3, "no-console"), (6, "no-eval"), (7, "no-var"), (8, "eqeqeq"), (9, "no-any")]


@settings(deadline=None, max_examples=30)
@given(st.lists(st.sampled_from(["..", ".", "", "a", "b"]), max_size=6))
def test_python_and_column_folding_agree(parts):
    out = []
    for p in parts:
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    assert fold("/".join(parts)) == "/".join(out)


def fold(path):
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    key = "cache"
    memo = fold.__dict__.setdefault(key, {})
    if path not in memo:
        memo[path] = s.createDataFrame([(path,)], "p string").select(C.fold_path(F.col("p")).alias("f")).first()["f"]
    return memo[path]


def test_languages_and_ignored_places(spark):
    paths = ["a/B.PY", ".eslintrc.json", "noext", ".py", "node_modules/x.js", "x/package-lock.json", "./ok\\deep.ts"]
    df = spark.createDataFrame([(p, "") for p in paths], "path string, content string")
    assert sorted((r["path"], r["language"]) for r in text.admit(df).collect()) == [(".eslintrc.json", "json"), ("a/B.PY", "python"), ("ok/deep.ts", "typescript")]


def test_resolver_orders(spark):
    files = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b/index.ts", "src/lib.js", "pkg/ui/src/index.ts", "pkg/ui/src/x.ts", "py/pkg/__init__.py", "py/pkg/m.py", "app/util.ts"]], "path string")
    config = resolve.ResolverConfig(base_url="app", aliases=[("@/", "src/", True), ("lib", "src/lib.js", False)], workspaces=[resolve.Workspace("@x/ui", "pkg/ui", "dist/index.js", {"./x": "dist/x.js"})])
    want = {
        ("src/a.ts", "./b"): "src/b/index.ts", ("src/a.ts", "./lib"): "src/lib.js", ("src/b/index.ts", "../a.js"): "src/a.ts", ("src/a.ts", "@/b"): "src/b/index.ts",
        ("src/a.ts", "lib"): "src/lib.js", ("src/a.ts", "@x/ui"): "pkg/ui/src/index.ts", ("src/a.ts", "@x/ui/x"): "pkg/ui/src/x.ts", ("src/a.ts", "util"): "app/util.ts", ("src/a.ts", "react"): None,
        ("py/pkg/m.py", "."): "py/pkg/__init__.py", ("py/pkg/m.py", ".m"): "py/pkg/m.py", ("py/pkg/m.py", "pkg.m"): "py/pkg/m.py", ("py/pkg/m.py", "os"): None,
    }
    imports = spark.createDataFrame([(p, i, s, "external", 1) for i, (p, s) in enumerate(want)], "path string, pos int, specifier string, kind string, line int")
    got = {(r["path"], r["specifier"]): r["resolved"] for r in resolve.resolve_imports(imports, files, config).collect()}
    assert got == want


def test_part_graph_parses_its_files_once(spark):
    for name in ("part_graph_nodes", "part_graph_edges"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapIn" not in plan  # the parsed files were written before, all planes read them


def test_parts_are_dealt_out_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(adapters, "PARTS_A_TASK", 50, raising=False)
    assert adapters.part_code(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_endings_are_tried_in_order(spark):
    rng = random.Random(4)
    endings = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".css", ".scss"]
    tails = ["", *endings, *[f"/index{e}" for e in endings], ".go"]
    names = ["a", "b/a", "b", "index", "b/index"]
    paths = sorted({rng.choice(names) + rng.choice(tails) for _ in range(60)})
    specs = [f"./{n}{t}" for n in names for t in ("", ".js", ".mjs", ".ts", "/index")]

    def tries(base):
        return [base, *[base + e for e in endings], *[f"{base}/index{e}" for e in endings]]

    want = {}
    for s in specs:
        base = s[2:]
        order = tries(base) + (tries(base.rsplit(".", 1)[0]) if base.endswith((".js", ".mjs")) else [])
        want[s] = next((p for p in order if p in paths), None)
    imports = spark.createDataFrame([("x.js", i, s, "external", 1) for i, s in enumerate(specs)], "path string, pos int, specifier string, kind string, line int")
    got = resolve.resolve_imports(imports, spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r["specifier"]: r["resolved"] for r in got.collect()} == want
    widest = imports.sparkSession.range(1).select(F.size(resolve._script(F.lit("./a"), F.lit("x.js"), resolve.ResolverConfig())).alias("n")).first()["n"]
    assert widest <= 4  # not one candidate an ending


def test_parsers_survive_odd_text():
    for language in ("python", "javascript", "go", "rust", "java"):
        for content in ("", None, "{{{{", "'\"`", "def (", "import", "\x00", "fn f(", "class {"):
            assert parse.parse_file("x", language, content)["parse_error"] is None
    broken = parse.parse_python("x.py", "def f(:\n    g()\nclass A:\n    def m(self):\n        h()\n")
    assert [s["name"] for s in broken["symbols"]] == ["f", "A", "A.m"]


def test_rust_and_java_symbols():
    rust = parse.parse_generic("rust", "src/engine.rs", samples.FILES["src/engine.rs"])
    assert [(s["name"], s["kind"], s["exported"]) for s in rust["symbols"]] == [("Engine", "class", True), ("Engine.new", "method", True)]
    java = parse.parse_generic("java", "App.java", samples.FILES["src/main/java/demo/App.java"])
    assert [s["name"] for s in java["symbols"]] == ["App", "App.run"] and java["complexity"] == 2
    assert [i["kind"] for i in java["imports"]] == ["internal", "external"]


def test_domains_partition_files():
    nodes = [f"m{i // 4}/f{i}" for i in range(12)]
    edges = [(nodes[i], nodes[j]) for i in range(12) for j in range(i) if i // 4 == j // 4]
    found = domains.modularity_groups(nodes, edges + [(nodes[0], nodes[4])])
    assert set(found) == set(nodes) and len(set(found.values())) == 3
    assert domains.absorb_singles([["a/b/x", "a/b/y"], ["c/x", "c/y"], ["c/z"]]) == [["a/b/x", "a/b/y"], ["c/x", "c/y", "c/z"]]


def _absorb_by_scan(groups):
    """Every group of one against every larger group."""
    large = [g for g in groups if len(g) > 1]
    folders = lambda p: [x for x in p.split("/")[:-1] if x]
    shared = lambda a, b: a[: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))]
    common = []
    for g in large:
        c = folders(g[0])
        for p in g:
            c = shared(c, folders(p))
        common.append(c)
    for (single,) in [g for g in groups if len(g) == 1]:
        near = [shared(c, folders(single)) for c in common]
        best = max(range(len(large)), key=lambda i: (len(near[i]), -i))
        large[best].append(single)
        common[best] = near[best]
    return large or groups


def test_groups_of_one_join_the_same_groups_as_by_a_scan():
    rng = random.Random(2)
    for _ in range(300):
        paths = [f"{'/'.join(rng.choices('ab', k=rng.randrange(4)))}/{i}" for i in range(25)]
        groups = []
        while paths:
            groups.append([paths.pop() for _ in range(min(len(paths), rng.choice([1, 1, 2, 3])))])
        assert domains.absorb_singles([list(g) for g in groups]) == _absorb_by_scan([list(g) for g in groups])


def test_groups_of_one_are_not_compared_with_every_group():
    groups = [[f"d{i}/a", f"d{i}/b"] for i in range(20_000)] + [[f"d{i}/c"] for i in range(20_000)]
    begun = time.perf_counter()
    assert domains.absorb_singles(groups)[19_999] == ["d19999/a", "d19999/b", "d19999/c"]
    assert time.perf_counter() - begun < 20  # 4e8 comparisons take minutes


def test_project_end_to_end(spark, tmp_path):
    p = Project(spark, samples.frame(spark), AnalyzeOptions("demo", samples.CONFIG)).analyze()
    assert p.files.filter("path like 'node_modules%'").count() == 0
    resolved = {(r["path"], r["specifier"]): r["resolved"] for r in p.imports.collect()}
    assert resolved["go/main.go", "example.com/demo/go/store"] == "go/store/store.go"
    assert resolved["src/main.rs", "crate::engine::Engine"] == "src/engine.rs" and resolved["src/main.rs", "mod::engine"] == "src/engine.rs"
    assert resolved["src/main/java/demo/App.java", "demo.util.Text"] == "src/main/java/demo/util/Text.java"
    assert resolved["py/main.py", ".tools"] == "py/tools.py" and resolved["web/app.js", "express"] is None
    assert p.cycles.count() == 1 and p.edges.filter("circular").count() == 2
    assert p.members.count() == p.files.count() == p.members.select("path").distinct().count()
    assert p.find_symbol("SUM").first()["called_by"] == ["web/app.js", "web/label.js"]
    assert p.describe_file("web/math.js").first()["imported_by"] == ["web/app.js", "web/label.js"] and p.describe_file("none").count() == 0
    compact, full = p.overview("compact"), p.overview("full")
    assert len(compact) < len(full) and p.overview("full", 60).count("##") < full.count("##")
    nodes, edges = export.graph_rows(p.nodes, p.edges)
    assert nodes.count() < p.nodes.count() and edges.count() < p.edges.count()
    s = p.summary_row()
    assert s["circular_deps"] == 1 and s["error"] == 1 and export.gate(s, fail_on_cycles=True) and not export.gate(s, max_complexity=50)
    p.write(str(tmp_path))
    assert (tmp_path / "CODEMAP.md").read_text().startswith("# CODEMAP — demo")


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(0, 0, "x" * 370), (1, 0, "x" * 370), (2, 0, "x")], "rank int, pos int, text string")
    assert [r["rank"] for r in viz.within_budget(df, 150, 10).orderBy("rank").collect()] == [0]
    assert viz.within_budget(df, None, 10).count() == 3


def test_folder_scan_and_settings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "src" / "a b.py").write_text("x = 1")
    (tmp_path / ".hidden" / "c.py").write_text("x")
    (tmp_path / "big.py").write_text("x" * 20)
    (tmp_path / "link.py").symlink_to(tmp_path / "src" / "a b.py")
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]},}}')
    (tmp_path / "go.mod").write_text("module example.com/m\n")
    files, skipped = file_source.discover(spark, str(tmp_path), 15)
    assert [r["path"] for r in files.collect()] == ["src/a b.py"] and {r["path"] for r in skipped.collect()} == {"big.py", "tsconfig.json"}
    with pytest.raises(ValueError, match="Invalid rootDir"):
        file_source.valid_root(tmp_path / "none")
    assert not file_source.is_within_root(tmp_path / "src", tmp_path / "src" / ".." / "go.mod")
    config = projectconfig.read_config(str(tmp_path))
    assert config.go_module == "example.com/m" and config.aliases == [("@/", "./src/".removeprefix("./"), True)]
    assert projectconfig.parse_jsonc("{bad") is None


def test_log_parsing(spark, tmp_path):
    log = "\x1es1\x1fann\x1f2024-01-01T00:00:00+00:00\n3\t1\tsub/a.py\n-\t-\tsub/b.png\n\x1es2\x1fbob\x1fnever\n1\t1\tsub/a.py\n"
    (tmp_path / "log").write_text(log)
    rows, heads = gitlog.read_log(spark, str(tmp_path / "log"), "sub/")
    assert sorted((r["path"], r["added"], r["removed"]) for r in rows.collect()) == [("a.py", 3, 1), ("b.png", 0, 0)] and heads.count() == 1
    assert gitlog.read_history(spark, str(tmp_path))[0].count() == 0
    for args in (["init", "-q"], ["add", "log"], ["-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "m"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    assert [r["path"] for r in gitlog.read_history(spark, str(tmp_path))[0].collect()] == ["log"]
