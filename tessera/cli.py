"""Command line: ``python -m tessera.cli analyze FOLDER``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.operators import export
from tessera.plans.project import Project, snapshots


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=["analyze", "codemap", "snapshots"])
    parser.add_argument("folder")
    parser.add_argument("--out")
    parser.add_argument("--detail", choices=["compact", "normal", "full"], default="normal")
    parser.add_argument("--max-tokens", type=int)
    parser.add_argument("--points", type=int, default=20)
    parser.add_argument("--fail-on-cycles", action="store_true")
    parser.add_argument("--fail-on-error", action="store_true")
    parser.add_argument("--max-complexity", type=float)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "snapshots":
        print(snapshots(spark, a.folder, a.points))
        return 0
    project = Project.from_folder(spark, a.folder)
    if a.command == "codemap":
        print(project.overview(a.detail, a.max_tokens))
        return 0
    out = a.out or str(Path(a.folder) / ".tessera")
    Path(out).mkdir(parents=True, exist_ok=True)
    project.write(out)
    print(export.terminal_summary(project))
    reasons = export.gate(project.summary_row(), a.max_complexity, a.fail_on_cycles, a.fail_on_error)
    for r in reasons:
        print(r, file=sys.stderr)
    return int(bool(reasons))


if __name__ == "__main__":
    sys.exit(main())
