"""Exports: the code map in Markdown, graph documents in JSON, terminal summaries and gates.

They format a handful of bounded summary tables on the driver; whatever grows with the project stays a DataFrame until
it has been cut to the rows that a section shows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"compact": 0, "normal": 1, "full": 2}
FOOTER = "\n---\n_Contexto para una IA. Pegalo al inicio de la conversación._\n"
SPARKS = "▁▂▃▄▅▆▇█"


def estimated_tokens(text: str) -> int:
    """About 3.7 UTF-16 units a token."""
    return math.ceil(len(text.encode("utf-16-le")) // 2 / 3.7)


def rounded(x: float) -> int:
    return math.floor(x + 0.5)


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def grouped(n: int) -> str:
    """Thousands separated as in Spanish: not below five digits."""
    return f"{n:,}".replace(",", ".") if n >= 10_000 else str(n)


def bar(value: int, most: int, width: int = 18) -> str:
    filled = rounded(value / most * width) if most > 0 else 0
    return "█" * filled + "░" * max(0, width - filled)


def sparkline(values: list[float]) -> str:
    low, high = min(values, default=0), max(values, default=0)
    return "".join(SPARKS[rounded((v - low) / max(1, high - low) * 7)] for v in values)


def assemble(sections: list[tuple[int, str, str]], detail: str, budget: int | None) -> str:
    """Sections (rank, least detail, text) in order of rank while they fit; the first always does, and the first that
    doesn't fit ends the map."""
    wanted = sorted((s for s in sections if LEVELS[s[1]] <= LEVELS[detail]), key=lambda s: s[0])
    used, chosen = estimated_tokens(FOOTER), []
    for _, _, text in wanted:
        cost = estimated_tokens(text) + 2
        if budget and chosen and used + cost > budget:
            break
        chosen.append(text)
        used += cost
    return "\n\n".join(chosen) + FOOTER


def code_map(project, detail: str = "normal", max_tokens: int | None = None) -> str:
    """The code map of an analysed project (see ``tessera.plans.project``)."""
    level = LEVELS[detail]
    s = project.summary_row()
    out: list[tuple[int, str, str]] = []

    def add(rank: int, least: str, lines: list[str]) -> None:
        out.append((rank, least, "\n".join(lines).rstrip()))

    head = [
        f"# CODEMAP — {project.name}",
        f"> {project.analyzed_at[:10]} · {s['total_files']} archivos · {grouped(s['total_loc'])} líneas · salud {s['score']}/100 ({s['grade']})",
        "## Resumen",
        f"- Símbolos: {s['total_symbols']} · complejidad promedio: {number(s['avg_complexity'])}",
        f"- Issues: {s['total_issues']} ({s['error']} error, {s['warning']} warning)",
        f"- Dependencias circulares: {s['circular_deps']}",
    ]
    if s["stack"]:
        head.append(f"- Stack: {', '.join(s['stack'])}")
    add(0, "compact", head)

    shown = {0: 0, 1: 8, 2: 999}[level]
    groups = project.domains.orderBy(F.desc("size"), "id").collect()
    if groups:
        files = {}
        if shown:
            ranked = project.members.groupBy("domain").agg(F.slice(F.array_sort(F.collect_set("path")), 1, shown).alias("files"))
            files = {r["domain"]: r["files"] for r in ranked.collect()}
        lines = ["## Dominios (áreas del proyecto)", ""]
        for g in groups:
            lines.append(f"### {g['label']} — {g['size']} archivo(s)")
            lines += [f"- `{f}`" for f in files.get(g["id"], [])]
            if shown and g["size"] > shown:
                lines.append(f"- … +{g['size'] - shown} más")
            lines.append("")
        add(1, "compact", lines)

    cycles = [r["members"] for r in project.cycles.orderBy("cycle_id").collect()]
    if cycles:
        add(2, "compact", ["## ⚠️ Dependencias circulares", "", *["- " + " → ".join(f"`{f}`" for f in c) + " → (vuelve)" for c in cycles]])
    hot = project.hotspots().collect()
    if hot:
        rows = [f"| `{h['path']}` | {rounded(h['score'] * 100)} | {h['complexity']} | {h['commits']} |" for h in hot[: 12 if level else 5]]
        add(3, "compact", ["## 🔥 Hotspots (complejo + cambia mucho)", "", "| Archivo | Score | Complejidad | Commits |", "|---|--:|--:|--:|", *rows])
    hidden = project.temporal_coupling().collect()
    if hidden:
        rows = [f"| `{c['a']}` | `{c['b']}` | {c['shared']} | {rounded(c['coupling'] * 100)}% |" for c in hidden[: 12 if level else 4]]
        add(3, "normal", ["## 🔗 Acoplamiento oculto (cambian juntos pero no se importan)", "", "| Archivo A | Archivo B | Juntos | Fuerza |", "|---|---|--:|--:|", *rows])
    if s["entry_points"]:
        add(3, "compact", ["## Puntos de entrada probables", "", *[f"- `{e}`" for e in s["entry_points"]]])
    langs = sorted(s["files_by_language"].items(), key=lambda x: (-x[1], x[0]))
    if langs:
        most = max(n for _, n in langs)
        add(4, "normal", ["## Lenguajes", "", "```", *[f"{name:<12} {bar(n, most)} {n}" for name, n in langs], "```"])
    internal = project.edges.filter("type = 'imports' and target not like 'ext:%'")
    adjacency = internal.groupBy("source").agg(F.array_sort(F.collect_list(F.concat("target", F.when(F.col("circular"), F.lit("  (circular)")).otherwise(F.lit(""))))).alias("t")).orderBy("source").collect() if level else []
    if adjacency:
        lines = ["## Dependencias internas (quién importa a quién)", "", "```"]
        for r in adjacency:
            lines += [r["source"], *[f"  → {t}" for t in r["t"]]]
        add(5, "normal", [*lines, "```"])
    if level:
        large = project.files.orderBy(F.desc("loc"), "path").limit(10).collect()
        rows = [f"| `{f['path']}` | {f['loc']} | {f['complexity']} | {f['issues']} |" for f in large]
        add(6, "normal", ["## Archivos más grandes", "", "| Archivo | Líneas | Complejidad | Issues |", "|---|--:|--:|--:|", *rows])
        bad = project.issues.filter("severity = 'error'").groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "rule_pos", "message"))), 1, 5).alias("i")).orderBy("path").limit(10).collect()
        if bad:
            lines = ["## Issues graves", ""]
            for r in bad:
                lines += [f"- `{r['path']}`", *[f"  - línea {i['line']}: {i['message']}" for i in r["i"]]]
            add(7, "normal", lines)
    if level == 2:
        per = project.symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "name", "exported", "async"))).alias("s")).orderBy("path").collect()
        lines = ["## Símbolos por archivo", ""]
        for r in per:
            lines += [f"### `{r['path']}`", *[f"- {x['kind']} `{x['name']}`{' (export)' if x['exported'] else ''}{' async' if x['async'] else ''}" for x in r["s"]], ""]
        if per:
            add(8, "full", lines)
        per = project.issues.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "rule_pos", "severity", "message"))).alias("i")).orderBy("path").collect()
        lines = ["## Todos los issues", ""]
        for r in per:
            lines += [f"### `{r['path']}`", *[f"- [{x['severity']}] línea {x['line']}: {x['message']}" for x in r["i"]], ""]
        if per:
            add(9, "full", lines)
    return assemble(out, detail, max_tokens)


def graph_rows(nodes: DataFrame, edges: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """One JSON document a row for nodes and edges; the slim graph keeps files, domains and three relations."""
    if not full:
        nodes = nodes.filter(F.col("type").isin("file", "domain"))
        edges = edges.filter(F.col("type").isin("imports", "member-of", "co-change"))
    as_json = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))
    return as_json(nodes), as_json(edges)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, full: bool = False) -> None:
    n, e = graph_rows(nodes, edges, full)
    n.write.mode("overwrite").text(f"{path}/nodes")
    e.write.mode("overwrite").text(f"{path}/edges")


def gate(summary: dict, max_complexity: float | None = None, fail_on_cycles: bool = False, fail_on_error: bool = False) -> list[str]:
    """Reasons to fail a build."""
    reasons = []
    if fail_on_cycles and summary["circular_deps"] > 0:
        reasons.append(f"{summary['circular_deps']} dependencias circulares")
    if fail_on_error and summary["error"] > 0:
        reasons.append(f"{summary['error']} issues de severidad error")
    if max_complexity is not None and summary["avg_complexity"] > max_complexity:
        reasons.append(f"complejidad promedio {number(summary['avg_complexity'])} > {number(max_complexity)}")
    return reasons


def terminal_summary(project) -> str:
    """A short report: totals, five hotspots, five hidden pairs."""
    s = project.summary_row()
    lines = [f"{project.name}: {s['total_files']} archivos, {s['total_loc']} líneas, salud {s['score']}/100 ({s['grade']})"]
    lines += [f"  {h['path']}  {rounded(h['score'] * 100)}" for h in project.hotspots().limit(5).collect()]
    lines += [f"  {c['a']} <-> {c['b']}  {rounded(c['coupling'] * 100)}%" for c in project.temporal_coupling().limit(5).collect()]
    return "\n".join(lines)
