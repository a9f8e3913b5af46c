"""Per-file extraction of imports, symbols, calls and complexity, one Arrow-backed pass over the files.

Python uses the standard syntax tree, and a line reader where the text isn't valid. The other languages are read by a
masking scanner: strings and comments are blanked in place, so that braces and words can be matched at their offsets.
A file that can't be read gives its row with ``parse_error``; it never fails the task.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import dims

SCHEMA = (
    "path string, language string, complexity int, doc_coverage int, parse_error string, exports array<string>, "
    "imports array<struct<specifier:string,kind:string,line:int>>, "
    "symbols array<struct<id:string,name:string,kind:string,line:int,end_line:int,exported:boolean,async:boolean,calls:array<string>,documented:boolean>>"
)
_IMPORT = pa.struct([("specifier", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
_SYMBOL = pa.struct([
    ("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("async", pa.bool_()),
    ("calls", pa.list_(pa.string())), ("documented", pa.bool_()),
])
_ARROW = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("complexity", pa.int32()), ("doc_coverage", pa.int32()), ("parse_error", pa.string()), ("exports", pa.list_(pa.string())),
    ("imports", pa.list_(_IMPORT)), ("symbols", pa.list_(_SYMBOL)),
])


def _symbol(path: str, name: str, kind: str, line: int, end: int, exported: bool, is_async: bool, calls: list[str], documented: bool, ident: str | None = None) -> dict:
    return {"id": ident or f"{path}#{name}", "name": name, "kind": kind, "line": line, "end_line": end, "exported": exported, "async": is_async, "calls": list(dict.fromkeys(calls)), "documented": documented}


# ---------------------------------------------------------------- Python

_PY_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)


def _py_calls(body: list[ast.stmt]) -> list[str]:
    out = []
    for stmt in body:
        for node in ast.walk(stmt):
            if isinstance(node, ast.Call):
                f = node.func
                if isinstance(f, ast.Attribute):
                    out.append((node.lineno, node.col_offset, f.attr))
                elif isinstance(f, ast.Name):
                    out.append((node.lineno, node.col_offset, f.id))
    return [name for _, _, name in sorted(out)]


def parse_python(path: str, content: str) -> dict:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(path, content)
    imports, symbols = [], []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [{"specifier": a.name, "kind": "external", "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append({"specifier": "." * node.level + (node.module or ""), "kind": "internal" if node.level else "external", "line": node.lineno})

    def add(node, name: str, kind: str) -> None:
        symbols.append(_symbol(path, name, kind, node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), isinstance(node, ast.AsyncFunctionDef), _py_calls(node.body), ast.get_docstring(node, clean=False) is not None))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add(node, node.name, "function")
        elif isinstance(node, ast.ClassDef):
            add(node, node.name, "class")
            for inner in node.body:
                if isinstance(inner, ast.FunctionDef | ast.AsyncFunctionDef):
                    add(inner, f"{node.name}.{inner.name}", "method")
    complexity = 1
    for node in ast.walk(tree):
        complexity += isinstance(node, _PY_DECISIONS)
        if isinstance(node, ast.BoolOp):
            complexity += len(node.values) - 1
    return {"imports": imports, "symbols": symbols, "complexity": complexity, "exports": [s["name"] for s in symbols if s["exported"] and s["kind"] != "method"]}


def _python_lines(path: str, content: str) -> dict:
    """What a reader of lines and indents can tell of text that isn't valid Python."""
    imports, symbols, lines, owner = [], [], content.split("\n"), None
    for i, line in enumerate(lines, 1):
        if m := re.match(r"import\s+([\w.]+(?:\s*,\s*[\w.]+)*)", line):
            imports += [{"specifier": s.strip(), "kind": "external", "line": i} for s in m[1].split(",")]
        elif m := re.match(r"from\s+(\.*[\w.]*)\s+import\b", line):
            imports.append({"specifier": m[1], "kind": "internal" if m[1].startswith(".") else "external", "line": i})
        elif m := re.match(r"(\s*)(async\s+)?(def|class)\s+(\w+)", line):
            inner = bool(m[1])
            if inner and (owner is None or m[3] == "class"):
                continue
            end = next((j for j in range(i, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1])), len(lines))
            body = "\n".join(lines[i:end])
            owner = owner if inner else (m[4] if m[3] == "class" else None)
            name = f"{owner}.{m[4]}" if inner else m[4]
            kind = "method" if inner else ("class" if m[3] == "class" else "function")
            symbols.append(_symbol(path, name, kind, i, end, not m[4].startswith("_"), bool(m[2]), re.findall(r"(\w+)\s*\(", body), bool(re.match(r"\s*[rRuUbB]*(?:\"\"\"|'''|\"|')", body))))
        elif line.strip() and not line[0].isspace():
            owner = None
    masked = re.sub(r"#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'", " ", content)
    complexity = 1 + len(re.findall(r"\b(?:if|elif|for|while|except|and|or|assert)\b", masked))
    return {"imports": imports, "symbols": symbols, "complexity": complexity, "exports": [s["name"] for s in symbols if s["exported"] and s["kind"] != "method"]}


# ---------------------------------------------------------------- languages with braces


def mask(text: str, char_quotes: bool = True, templates: bool = True) -> str:
    """The text with strings and comments blanked, offsets and line ends kept."""
    quotes = r'"(?:\\.|[^"\\\n])*"?' + (r"|'(?:\\.|[^'\\\n])*'?" if char_quotes else r"|'(?:\\.|[^'\\\n])'") + (r"|`(?:\\.|[^`\\])*`?" if templates else "")
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + quotes, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _close(masked: str, at: int) -> int:
    """Offset of the bracket that closes the brace at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(masked)


def _depths(masked: str) -> list[tuple[int, int]]:
    out, depth = [(0, 0)], 0
    for m in re.finditer(r"[{}()\[\]]", masked):
        depth += 1 if m[0] in "{([" else -1
        out.append((m.end(), max(depth, 0)))
    return out


def _depth_at(depths: list[tuple[int, int]], at: int) -> int:
    lo, hi = 0, len(depths) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if depths[mid][0] <= at else (lo, mid - 1)
    return depths[lo][1]


_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "match", "loop", "fn", "func", "super", "else", "do", "case", "in", "of", "throw", "delete", "void", "yield", "synchronized", "import", "require", "constructor"}


_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "synchronized", "new", "try", "do"}


def _declares(masked: str, at: int) -> bool:
    """Whether the parenthesis at ``at`` belongs to a declaration: a body or a clause before one follows it."""
    depth = 0
    for m in re.compile(r"[()]").finditer(masked, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return bool(re.match(r"\s*(?::[^{;=()]+|throws[\w.,\s]+|->[^{;]+)?\{", masked[m.end() : m.end() + 200]))
    return False


def _calls(masked: str) -> list[str]:
    out = []
    for m in re.finditer(r"(?<![\w$])(fn\s+|func\s+|function\s+)?([A-Za-z_$][\w$]*)!?\s*(?:<[\w\s,.]*>)?\(", masked):
        if not m[1] and m[2] not in _NOT_CALLS and not _declares(masked, m.end() - 1):
            out.append(m[2])
    return out


def _preceded_by_comment(text: str, at: int, masked: str) -> bool:
    before = text[:at].rstrip()
    return before.endswith("*/") or bool(re.match(r"\s*//", before.rsplit("\n", 1)[-1])) and not masked[: len(before)].rsplit("\n", 1)[-1].strip()


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def parse_javascript(path: str, content: str) -> dict:
    m_text = mask(content)
    depths = _depths(m_text)
    found: list[tuple[int, str]] = []
    for m in re.finditer(r"(?<![\w$.])(?:import|export)\b[^;'\"()=]*?\bfrom\s*(['\"])([^'\"\n]*)\1|(?<![\w$.])import\s*(['\"])([^'\"\n]*)\3|(?<![\w$.])(?:require|import)\s*\(\s*(['\"`])([^'\"`\n]*)\5\s*\)", content):
        if m_text[m.start()].strip():
            found.append((m.start(), m[2] or m[4] or m[6] or ""))
    imports, seen = [], set()
    for at, spec in found:
        if spec and spec not in seen:
            seen.add(spec)
            imports.append({"specifier": spec, "kind": "internal" if spec.startswith((".", "/")) else "external", "line": _line(content, at)})
    symbols, exports = [], []
    start = r"(?<![\w$.])(export\s+)?(default\s+)?"
    shapes = re.compile(start + r"(?:(async\s+)?function\s*\*?\s*(?P<f>[\w$]+)|(?:abstract\s+)?(?P<c>class)\s+(?P<cn>[\w$]+)|(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=;]+)?=\s*(?P<va>async\s+)?(?:function\b|(?:\([^()]*\)|[\w$]+)\s*(?::[^=;{]+)?=>))")
    for m in shapes.finditer(m_text):
        if _depth_at(depths, m.start()) or "abstract" in m[0].split("class")[0]:
            continue
        exported = bool(m[1])
        brace = m_text.find("{", m.end())
        arrow_expr = m["v"] and not m_text[m.end() :].lstrip().startswith("{") and "function" not in m[0]
        if arrow_expr or brace < 0:
            stop = m_text.find("\n", m.end())
            end = len(content) if stop < 0 else stop
        else:
            end = _close(m_text, brace)
        name = m["f"] or m["cn"] or m["v"]
        at = m.start() if not m["v"] else m.start() + m[0].index("=") + 1
        inside = m_text[m.end() : end]
        symbols.append(_symbol(path, name, "class" if m["c"] else "function", _line(content, at + len(content[at:]) - len(content[at:].lstrip())), _line(content, end), exported, bool(m[3] or m["va"]), _calls(inside), not m["v"] and _preceded_by_comment(content, m.start(), m_text)))
        if exported:
            exports.append("default" if m[2] else name)
        if m["c"] and brace >= 0:
            for mm in re.finditer(r"(?:^|[;}\n{])\s*((?:public|private|protected|static|readonly|override|get|set)\s+)*(async\s+)?\*?\s*([\w$#]+)\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;]+)?\{", m_text[brace + 1 : end]):
                base = brace + 1
                if mm[3] in _NOT_CALLS - {"constructor"} or _depth_at(depths, base + mm.start(3)) != 1:
                    continue
                stop = _close(m_text, base + mm.end() - 1)
                at = base + mm.start() + len(mm[0]) - len(mm[0].lstrip(" \t\n;{}"))
                symbols.append(_symbol(path, f"{name}.{mm[3]}", "method", _line(content, at), _line(content, stop), exported, bool(mm[2]), _calls(m_text[base + mm.end() : stop]), _preceded_by_comment(content, at, m_text)))
    for m in re.finditer(r"(?<![\w$.])export\s*\{([^}]*)\}", m_text):
        exports += [p.split(" as ")[-1].strip() for p in m[1].split(",") if p.strip()]
    if re.search(r"(?<![\w$.])export\s+default\b", m_text) and "default" not in exports:
        exports.append("default")
    complexity = 1 + len(re.findall(r"(?<![\w$.])(?:if|for|while|case|catch|do)\b|&&|\|\||\?\?(?!=)|(?<![?.])\?(?![?.:])", m_text))
    return {"imports": imports, "symbols": symbols, "complexity": complexity, "exports": list(dict.fromkeys(exports))}


# One row a language: imports, containers, functions, what makes a name public, decisions.
SPECS = {
    "go": {
        "containers": r"(?m)^\s*(?:type\s+)?(?P<name>\w+)\s+(?:struct|interface)\s*\{",
        "functions": r"(?m)^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(",
        "decisions": r"\b(?:if|for|case|select)\b|&&|\|\|",
    },
    "rust": {
        "containers": r"(?m)^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)",
        "functions": r"(?m)(?P<vis>pub(?:\([^)]*\))?\s+)?(?:const\s+|unsafe\s+)*(?P<async>async\s+)?fn\s+(?P<name>\w+)\s*(?:<[^(]*>)?\(",
        "decisions": r"\b(?:if|while|for|loop)\b|=>|&&|\|\||\?(?=[;.)\s])",
    },
    "java": {
        "containers": r"(?P<vis>(?:\b(?:public|protected|private|static|final|abstract|sealed)\s+)*)\b(?:class|interface|enum|record)\s+(?P<name>\w+)",
        "functions": r"(?m)(?:^|[{};])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?P<vis>(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>]+>\s+)?(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:throws\s+[\w.,\s]+)?\{",
        "decisions": r"\b(?:if|for|while|case|catch|do)\b|&&|\|\||(?<![<,\s])\s*\?(?!\s*(?:extends|super)\b|\s*[>,])",
    },
}
# Fixed: packages of the platform.
_JDK = ("java.", "javax.", "jdk.", "sun.", "com.sun.")


def _generic_imports(language: str, content: str, masked: str) -> list[dict]:
    specs: list[tuple[str, str]] = []
    if language == "go":
        for m in re.finditer(r"(?m)^import\s*(?:\(([^)]*)\)|[^\n\"]*\"([^\"\n]+)\")", content):
            for s in re.findall(r'"([^"\n]+)"', m[1]) if m[1] is not None else [m[2]]:
                specs.append((s, "internal" if "." in s or "/" in s else "external"))
    elif language == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+([^;]+);|mod\s+(\w+)\s*;)", masked):
            for s in [f"mod::{m[2]}"] if m[2] else _use_tree(re.sub(r"\s+", " ", m[1]).strip()):
                specs.append((s, "internal" if s.split("::")[0] in ("crate", "self", "super", "mod") else "external"))
    else:
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", masked):
            specs.append((m[1], "external" if m[1].startswith(_JDK) else "internal"))
    return [{"specifier": s, "kind": k, "line": 1} for s, k in dict(specs).items()]


def _use_tree(text: str) -> list[str]:
    """The paths of a Rust use tree."""
    text = re.sub(r"\s+as\s+\w+", "", text)
    if "{" not in text:
        return [text.replace(" ", "").removesuffix("::*")]
    head, rest = text.split("{", 1)
    inner, depth, part, parts = rest[: rest.rfind("}")], 0, "", []
    for ch in inner:
        depth += (ch == "{") - (ch == "}")
        if ch == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    out = []
    for p in [*parts, part]:
        p = p.strip()
        if p == "self":
            out.append(head.strip().removesuffix("::"))
        elif p:
            out += _use_tree(head.strip() + p)
    return out


def parse_generic(language: str, path: str, content: str) -> dict:
    spec = SPECS[language]
    masked = mask(content, char_quotes=language != "rust", templates=language == "go")
    owners: list[tuple[int, int, str]] = []
    items: list[tuple[int, int, str, str, bool, bool, int]] = []

    def public(name: str, m: re.Match) -> bool:
        return bool(re.match(r"[A-Z]", name)) if language == "go" else ("pub" in (m["vis"] or "") if language == "rust" else "public" in (m["vis"] or ""))

    for m in re.finditer(spec["containers"], masked):
        brace, semi = masked.find("{", m.start()), masked.find(";", m.end())
        body = brace if brace >= 0 and (semi < 0 or brace < semi) else -1
        end = _close(masked, body) if body >= 0 else (semi if semi >= 0 else len(masked))
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        items.append((at, end, m["name"], "class", public(m["name"], m), False, body if body >= 0 else end))
        if language == "java" or language == "rust":
            owners.append((at, end, m["name"]))
    if language == "rust":
        for m in re.finditer(r"(?m)^\s*(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s*(?:[\w:<>,'&\s]+?\s+for\s+)?&?(?:\w+::)*(?P<name>\w+)[^{;]*\{", masked):
            owners.append((m.start(), _close(masked, m.end() - 1), m["name"]))
    for m in re.finditer(spec["functions"], masked):
        if language == "java" and m["name"] in _CONTROL:
            continue
        brace, semi = masked.find("{", m.end() - 1), masked.find(";", m.end())
        body = brace if brace >= 0 and (semi < 0 or brace < semi or language != "rust") else -1
        end = _close(masked, body) if body >= 0 else (semi if semi >= 0 else len(masked))
        at = m.start() + len(m[0]) - len(m[0].lstrip(" \t\r\n{};"))
        owner = m["owner"] if language == "go" else next((n for a, b, n in sorted(owners, key=lambda o: o[1] - o[0]) if a < at < b), None)
        name = f"{owner}.{m['name']}" if owner else m["name"]
        items.append((at, end, name, "method" if owner else "function", public(m["name"], m), language == "rust" and bool(m["async"]), body if body >= 0 else end))
    symbols, used = [], set()
    for at, end, name, kind, exported, is_async, body in sorted(items):
        line = _line(content, at)
        ident = f"{path}#{name}@{line}" if name in used else f"{path}#{name}"
        used.add(name)
        documented = _preceded_by_comment(content, at, masked) and not (language == "go" and kind == "class")
        symbols.append(_symbol(path, name, kind, line, _line(content, end), exported, is_async, _calls(masked[body:end]), documented, ident))
    complexity = 1 + len(re.findall(spec["decisions"], masked))
    return {"imports": _generic_imports(language, content, masked), "symbols": symbols, "complexity": complexity, "exports": [s["name"] for s in symbols if s["exported"]]}


def parse_file(path: str, language: str, content: str | None) -> dict:
    """The whole row of a file; complexity 1 and full coverage where nothing was parsed."""
    row = {"path": path, "language": language, "complexity": 1, "doc_coverage": 100, "parse_error": None, "exports": [], "imports": [], "symbols": []}
    content = content or ""
    if language not in dims.PARSEABLE:
        return row
    if len(content.encode("utf-16-le")) // 2 > dims.MAX_FILE_CHARS:
        return row | {"parse_error": "file too large"}
    try:
        parsed = parse_python(path, content) if language == "python" else parse_javascript(path, content) if language in dims.JS_LIKE else parse_generic(language, path, content)
    except Exception as e:  # an odd file must not fail the whole job: its row says what went wrong
        return row | {"parse_error": f"{type(e).__name__}: {e}"}
    n = len(parsed["symbols"])
    coverage = int(100 * sum(s["documented"] for s in parsed["symbols"]) / n + 0.5) if n else 100
    return row | parsed | {"doc_coverage": coverage}


def parse(files: DataFrame) -> DataFrame:
    """``files(path, language, content)`` to one nested row a file."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([parse_file(*row) for row in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content")), strict=True)], schema=_ARROW)

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)
