"""Fixed values that results depend on: languages, ignored names, rules, stacks, thresholds."""

from __future__ import annotations

# Fixed: extension to language.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "java": "java", "css": "css", "scss": "css", "json": "json", "md": "markdown", "mdx": "markdown",
}
# Fixed: language to display label.
LABELS = {
    "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "jsx": "JSX", "tsx": "TSX", "go": "Go", "rust": "Rust", "java": "Java",
    "css": "CSS", "json": "JSON", "markdown": "Markdown", "unknown": "Otros",
}
PARSEABLE = ["python", "javascript", "typescript", "jsx", "tsx", "go", "rust", "java"]
JS_LIKE = ["javascript", "jsx", "typescript", "tsx"]
# Fixed: folders and files that are never analysed.
IGNORE_DIRS = [
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", "coverage", ".cache", ".turbo", ".parcel-cache",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "env", ".tox", ".idea", ".vscode", "vendor", "target",
]
IGNORE_FILES = [".DS_Store", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock"]
# Fixed: names of probable entry points.
ENTRY_NAMES = [
    "index.js", "index.ts", "index.jsx", "index.tsx", "index.mjs", "main.js", "main.ts", "main.jsx", "main.tsx", "main.py", "app.js", "app.ts", "app.py",
    "app.tsx", "server.js", "server.ts", "server.py", "cli.js", "cli.ts", "manage.py", "__main__.py", "wsgi.py", "asgi.py",
]
# Fixed: folder names too general to name a domain.
GENERIC_SEGMENTS = ["src", "lib", "app", "dist", "build", "source", "packages", "test", "tests", "__tests__"]
ROOT_LABEL = "raíz"
PALETTE = ["#6366f1", "#ec4899", "#14b8a6", "#f59e0b", "#8b5cf6", "#ef4444", "#3b82f6", "#10b981", "#f97316", "#a855f7", "#06b6d4", "#eab308"]

# Fixed: rules as (languages, id, category, severity, message, pattern). Patterns are ASCII: \b is spelt out as look-arounds.
_W, _NW = "(?<=[A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_B = "(?<![A-Za-z0-9_])"
RULES = [
    ("any", "todo", "todo", "info", "TODO pendiente", rf"(?i){_W}(?://|#|/\*)\s*TODO{_NW}"),
    ("any", "fixme", "todo", "warning", "FIXME pendiente", rf"(?i){_W}(?://|#|/\*)\s*FIXME{_NW}"),
    ("any", "hack", "smell", "warning", "HACK marcado en el código", rf"(?i){_W}(?://|#|/\*)\s*HACK{_NW}"),
    ("any", "xxx", "smell", "info", "Marca XXX en el código", rf"{_W}(?://|#|/\*)\s*XXX{_NW}"),
    ("js", "no-console", "debug", "warning", "console.* olvidado", rf"{_B}console\.(log|debug|info|warn|error|trace)\s*\("),
    ("js", "no-debugger", "debug", "error", "sentencia debugger activa", rf"{_B}debugger{_NW}"),
    ("js", "no-eval", "security", "error", "uso de eval()", rf"{_B}eval\s*\("),
    ("js", "no-inner-html", "security", "warning", "asignación a innerHTML (posible XSS)", r"\.innerHTML\s*="),
    ("js", "no-var", "style", "info", "usar const/let en vez de var", r"(^|[^.A-Za-z0-9_])var\s+[A-Za-z0-9_]"),
    ("js", "eqeqeq", "style", "info", "usar === en vez de ==", r"[^=!<>]==[^=]"),
    ("js", "no-any", "style", "info", 'tipo "any" explícito', rf":\s*any{_NW}"),
    ("python", "no-print", "debug", "info", "print() (¿debug olvidado?)", r"(^|[^.A-Za-z0-9_])print\s*\("),
    ("python", "no-eval", "security", "error", "uso de eval()", r"(^|[^.A-Za-z0-9_])eval\s*\("),
    ("python", "no-exec", "security", "error", "uso de exec()", r"(^|[^.A-Za-z0-9_])exec\s*\("),
    ("python", "bare-except", "smell", "warning", "except: sin tipo (atrapa todo)", r"^\s*except\s*:"),
    ("python", "eq-none", "style", "info", 'usar "is None" en vez de "== None"', rf"==\s*None{_NW}"),
    ("python", "shell-true", "security", "warning", "subprocess con shell=True", r"shell\s*=\s*True"),
]
# Fixed: file-name patterns and import patterns that reveal a stack.
STACK_FILES = [
    (r"^next\.config\.[mc]?[jt]s$", "Next.js"), (r"^nuxt\.config\.[mc]?[jt]s$", "Nuxt"), (r"^vite\.config\.[mc]?[jt]s$", "Vite"), (r"^astro\.config\.[mc]?[jt]s$", "Astro"),
    (r"^svelte\.config\.[mc]?[jt]s$", "Svelte"), (r"^remix\.config\.[mc]?[jt]s$", "Remix"), (r"^tailwind\.config\.[mc]?[jt]s$", "Tailwind CSS"),
    (r"^webpack\.config\.[mc]?[jt]s$", "Webpack"), (r"^rollup\.config\.[mc]?[jt]s$", "Rollup"), (r"^(jest|vitest)\.config\.[mc]?[jt]s$", "Tests (Jest/Vitest)"),
    (r"^tsconfig(\..+)?\.json$", "TypeScript"), (r"(?i)^dockerfile$", "Docker"), (r"^docker-compose\.ya?ml$", "Docker Compose"), (r"^pyproject\.toml$", "Python (pyproject)"),
    (r"^requirements.*\.txt$", "Python (pip)"), (r"^manage\.py$", "Django"), (r"^\.github$", "GitHub Actions"),
]
STACK_IMPORTS = [
    (r"^react(-dom)?$", "React"), (r"^vue$", "Vue"), (r"^svelte", "Svelte"), (r"^@angular/", "Angular"), (r"^next(/|$)", "Next.js"), (r"^express$", "Express"),
    (r"^fastify$", "Fastify"), (r"^koa$", "Koa"), (r"^@nestjs/", "NestJS"), (r"^d3$", "D3.js"), (r"^three$", "Three.js"), (r"^graphology", "Graphology"),
    (r"^(prisma|@prisma/client)$", "Prisma"), (r"^mongoose$", "MongoDB (Mongoose)"), (r"^django", "Django"), (r"^flask$", "Flask"), (r"^fastapi$", "FastAPI"),
    (r"^(sqlalchemy|sqlmodel)$", "SQLAlchemy"), (r"^pandas$", "pandas"), (r"^numpy$", "NumPy"), (r"^torch$", "PyTorch"), (r"^tensorflow", "TensorFlow"), (r"^pytest$", "pytest"),
]

# Fixed thresholds.
MAX_COMMIT_FILES, MIN_SHARED, MIN_COMMITS, MIN_COUPLING, TOP_COUPLING, TOP_HIDDEN, TOP_HOTSPOTS = 25, 3, 5, 0.4, 40, 15, 12
BUCKETS, DAY_MS, MAX_COMMITS, MAX_SYMBOL_NODES, MAX_FILE_CHARS, BIG_FILE_LOC = 48, 86_400_000, 8000, 6000, 1_500_000, 600
