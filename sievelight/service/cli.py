"""Command line: rank files for a question, report on usage, or serve the line protocol."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import discovery, usage
from ..operators.scoring import HashScorer, HttpScorer
from ..plans import rerank as plan
from ..sources import files as source
from . import endpoints, reports, rpc, settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievelight", description=__doc__)
    p.add_argument("command", choices=("rerank", "fast", "stats", "serve"))
    p.add_argument("query", nargs="?", default="")
    p.add_argument("paths", nargs="*", help="files, folders or globs; with none, the folder --root is searched")
    p.add_argument("--root", default=".")
    p.add_argument("-e", "--base-url", help="model server; without one, scores are the offline stand-in's")
    p.add_argument("-m", "--model")
    p.add_argument("-i", "--intent", choices=sorted(V.PRIORS))
    p.add_argument("-t", "--threshold", type=float)
    p.add_argument("-k", "--top", type=int, default=10)
    for flag in ("--strict", "--allow-empty", "--json"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--log", help="usage log, for stats")
    return p


def candidates(spark: SparkSession, root: str, paths: list[str], query: str) -> DataFrame:
    """(file_idx, file_path, body): the named files, or those that discovery finds below root."""
    tree = source.read_files(spark, [root])
    if paths:
        chosen = source.resolve_paths(tree, paths)
    else:
        found = discovery.discover(tree.withColumn("file_idx", F.lit(0).cast("bigint")), query).select("file_path")
        chosen = tree.join(found, "file_path", "left_semi")
    # at most a few hundred files are left: their order is their index
    from pyspark.sql import Window

    return chosen.withColumn("file_idx", F.row_number().over(Window.orderBy("file_path")).cast("bigint"))


def answer(spark: SparkSession, args: argparse.Namespace, get=endpoints.fetch) -> DataFrame:
    """(line) of the command's answer."""
    if args.command == "stats":
        log = source.read_usage(spark, args.log or str(settings.cache_dir() / "usage.jsonl"))
        return usage.report_lines(usage.latency_by_caller(log), usage.hook_share(log)).orderBy("part", "caller").select("line")
    files = candidates(spark, args.root, args.paths, args.query)
    if args.command == "fast":
        rows = plan.fast(files, args.query, top=args.top)
        return reports.json_lines(rows).select(F.col("value").alias("line")) if args.json else rows.orderBy("rank").select(F.concat_ws(" | ", F.col("rank").cast("string"), F.format_string("%.3f", "score"), "id").alias("line"))
    model, url = settings.resolve(args.model, args.base_url)
    scorer = HttpScorer(endpoints.addresses(url)["completion"], model or "default") if url else HashScorer()
    out = plan.rerank(files, args.query, scorer, intent=args.intent, threshold=args.threshold, top_k=args.top, allow_empty=args.allow_empty, strict=args.strict).results
    return reports.json_lines(out).select(F.col("value").alias("line")) if args.json else reports.result_lines(out).orderBy("rank").select("line")


def server(spark: SparkSession) -> rpc.Server:
    def rerank(query, paths=(), root=".", top=5):
        args = parser().parse_args(["rerank", query, *([paths] if isinstance(paths, str) else paths), "--root", root, "-k", str(top)])
        lines = [r["line"] for r in answer(spark, args).collect()]
        if not lines:
            raise rpc.ToolFailure(f"no candidate file for {query!r}; name paths or globs")
        return "\n".join(lines)

    text, listed = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    tools = [
        rpc.Tool("rerank", "Ranks chunks of files for a question and cites their lines.", rerank, ("query",), {"query": text, "paths": listed, "root": text, "top": {"type": "integer"}}),
        rpc.Tool("status", "Says which model server would be used.", lambda: str(endpoints.discover(settings.LOOPBACK, pinned=settings.resolve()[1]))),
    ]
    return rpc.Server(tools)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("rerank", "fast") and not args.query:
        print("a question is needed", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args.command == "serve":
        server(spark).serve(sys.stdin, sys.stdout)
        return 0
    for row in answer(spark, args).toLocalIterator():
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
