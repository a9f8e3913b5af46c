"""Settings that decide how imports resolve: script configuration, workspaces, Go module."""

from __future__ import annotations

import json
import re
from pathlib import Path

from tessera.operators.resolve import ResolverConfig, Workspace

# Fixed order of export conditions.
CONDITIONS = ["import", "module", "default", "require", "types"]


def parse_jsonc(text: str):
    """JSON with comments and trailing commas; None where it isn't."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare, flags=re.S)
    try:
        return json.loads(bare)
    except ValueError:
        return None


def _load(path: Path):
    return parse_jsonc(path.read_text(encoding="utf-8", errors="replace")) if path.is_file() else None


def pick_export(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        for c in CONDITIONS:
            if c in value and (found := pick_export(value[c])):
                return found
    return None


def entry_of(package: dict) -> str | None:
    exports = package.get("exports")
    top = exports.get(".", exports) if isinstance(exports, dict) else exports
    found = pick_export(top) or package.get("module") or package.get("main")
    return found.removeprefix("./") if isinstance(found, str) else None


def sub_exports(package: dict) -> dict[str, str]:
    exports = package.get("exports")
    pairs = ((k, pick_export(v)) for k, v in exports.items() if k.startswith("./")) if isinstance(exports, dict) else ()
    return {k: v.removeprefix("./") for k, v in pairs if v}


def compiler_options(path: Path, depth: int = 0) -> dict:
    """Own options over those of the files that it extends (relative ones, a few levels)."""
    config = _load(path)
    if not isinstance(config, dict) or depth > 4:
        return {}
    base: dict = {}
    parent = config.get("extends")
    if isinstance(parent, str) and parent.startswith("."):
        up = (path.parent / parent)
        base = compiler_options(up if up.suffix == ".json" else up.with_name(up.name + ".json"), depth + 1)
    return base | (config.get("compilerOptions") or {})


def read_config(root: str) -> ResolverConfig:
    top = Path(root)
    out = ResolverConfig()
    for name in ("tsconfig.json", "jsconfig.json"):
        options = compiler_options(top / name)
        base, paths = options.get("baseUrl"), options.get("paths") or {}
        if base is None and not paths:
            continue
        out.base_url = base.removeprefix("./").rstrip("/") if base is not None else None
        folder = "" if not out.base_url or out.base_url == "." else out.base_url + "/"
        for source, targets in paths.items():
            if targets:
                wild = source.endswith("*")
                out.aliases.append((source.removesuffix("*"), folder + targets[0].removeprefix("./").removesuffix("*"), wild))
        break
    package = _load(top / "package.json")
    globs = package.get("workspaces") if isinstance(package, dict) else None
    globs = globs.get("packages") if isinstance(globs, dict) else globs
    for glob in globs or []:
        folders = sorted(p for p in (top / glob[:-2]).glob("*") if p.is_dir()) if glob.endswith("/*") else [top / glob]
        for folder in folders:
            own = _load(folder / "package.json")
            if isinstance(own, dict) and own.get("name"):
                out.workspaces.append(Workspace(own["name"], str(folder.relative_to(top)), entry_of(own), sub_exports(own)))
    go = top / "go.mod"
    if go.is_file() and (m := re.search(r"(?m)^module\s+(\S+)", go.read_text(encoding="utf-8", errors="replace"))):
        out.go_module = m[1]
    return out
