"""python -m lodestone COMMAND: the engine's commands over a source tree."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestone.api import Engine
from lodestone.operators import enrich, report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [sub.add_parser(name)] + list(flags)
    c = add("index")[0]
    c.add_argument("--force", action="store_true")
    c.add_argument("--incremental", action="store_true")
    c = add("map")[0]
    c.add_argument("--tokens", type=int, default=1500)
    c = add("symbol")[0]
    c.add_argument("pattern")
    c.add_argument("--limit", type=int, default=10)
    for flag in ("--all", "--exact", "--json"):
        c.add_argument(flag, action="store_true")
    c = add("context")[0]
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    for flag in ("--json", "--include-content"):
        c.add_argument(flag, action="store_true")
    c = add("deps")[0]
    c.add_argument("file")
    c.add_argument("--direction", default="both")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--json", action="store_true")
    c = add("enrich")[0]
    for flag in ("--list", "--stats", "--clear-all", "--dry-run", "--force", "--batch", "--offline"):
        c.add_argument(flag, action="store_true")
    for flag in ("--set", "--clear", "--summary", "--when-to-use"):
        c.add_argument(flag)
    c.add_argument("--provider", default="gemini")
    c.add_argument("--top", type=int)
    c = add("evaluate")[0]
    c.add_argument("dataset")
    c.add_argument("--archive")
    return p


def run(engine: Engine, a) -> str:
    doc = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    if a.command == "index":
        return doc(engine.index(a.force, a.incremental))
    if a.command == "map":
        return engine.map(a.tokens)
    if a.command == "symbol":
        found = engine.symbol(a.pattern, a.limit, a.all, a.exact)
        return doc(found) if a.json else report.symbol_text(found)
    if a.command == "context":
        found = engine.context(a.query, a.limit, a.include_content)
        return doc(found) if a.json else report.context_text(found)
    if a.command == "deps":
        found = engine.deps(a.file, a.direction, a.depth)
        return doc(found) if a.json else report.deps_text(found)
    if a.command == "evaluate":
        return doc(engine.evaluate(a.dataset, a.archive))
    if a.clear_all or a.clear:
        return doc({"cleared": engine.enrich_clear(None if a.clear_all else a.clear)})
    if a.set:
        engine.enrich_set(a.set, a.summary, a.when_to_use)
        return doc({"set": a.set})
    if a.list:
        return doc(engine.enrich_list(a.top))
    if a.dry_run:
        return doc(engine.enrich_cost(a.provider, a.batch, a.top, a.force))
    if a.offline:
        return doc(engine.enrich(enrich.Offline(), a.top, a.force))
    return doc(engine.enrich_stats())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(run(Engine(spark, a.root), a))
    except (LookupError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
