"""A small mixed-language project as rows, for queries and tests that need source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.resolve import ResolverConfig

FILES = {
    "web/app.js": "import express from 'express';\nimport { sum } from './math';\n\n/** Starts. */\nexport function start(port) {\n  if (port > 0 && sum(port, 1)) {\n    console.log('up');\n  }\n}\n",
    "web/math.js": "import { label } from './label';\nexport function sum(a, b) {\n  return a + b;\n}\nexport const twice = (x) => sum(x, x);\n",
    "web/label.js": "import { sum } from './math';\nexport class Label {\n  text(n) {\n    return eval(n) || sum(n, 1);\n  }\n}\n",
    "py/main.py": "import os\nfrom .tools import clean\n\n\ndef run(x):\n    \"\"\"Runs.\"\"\"\n    if x and os.environ:\n        print(clean(x))\n",
    "py/tools.py": "class Box:\n    def open(self):\n        return clean(self)\n\n\ndef clean(x):\n    return [y for y in x if y]\n",
    "go/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/demo/go/store"\n)\n\nfunc main() {\n\tfmt.Println(store.Open())\n}\n',
    "go/store/store.go": "package store\n\n// Open opens.\nfunc Open() int {\n\tfor i := 0; i < 3; i++ {\n\t}\n\treturn 1\n}\n",
    "src/main.rs": "mod engine;\nuse crate::engine::Engine;\n\nfn main() {\n    Engine::new();\n}\n",
    "src/engine.rs": "pub struct Engine {\n    n: i32,\n}\n\nimpl Engine {\n    pub fn new() -> Self {\n        Engine { n: 1 }\n    }\n}\n",
    "src/main/java/demo/App.java": "package demo;\n\nimport demo.util.Text;\nimport java.util.List;\n\npublic class App {\n    public int run(int a) {\n        return a > 0 ? Text.size() : 0;\n    }\n}\n",
    "src/main/java/demo/util/Text.java": "package demo.util;\n\npublic class Text {\n    public static int size() {\n        return 1;\n    }\n}\n",
    "docs/readme.md": "# Demo\n* a point\n",
    "node_modules/x/index.js": "export default 1;\n",
}
CONFIG = ResolverConfig(go_module="example.com/demo")


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES.items()), "path string, content string")
