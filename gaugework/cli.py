"""Command line: python -m gaugework evaluate | benchmark | metrics."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .leaderboard import benchmark
from .registry import registry
from .render import leaderboard_html, scorecard_html, to_pdf
from .runner import PRESETS, evaluate
from .schema import GaugeError
from .sources.tables import read_metadata, read_table
from .texts import about


def metric_options(given: list[str]) -> dict[str, dict]:
    """``metric.option=value`` with a JSON value (anything else is a string)."""
    out: dict[str, dict] = {}
    for x in given:
        name, eq, value = x.partition("=")
        metric, dot, option = name.partition(".")
        if not (eq and dot and metric and option):
            raise GaugeError(f"expected metric.option=value, got {x!r}")
        try:
            out.setdefault(metric, {})[option] = json.loads(value)
        except ValueError:
            out.setdefault(metric, {})[option] = value
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugework")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--real", required=True)
    shared.add_argument("--metadata")
    shared.add_argument("--preset", choices=sorted(PRESETS))
    shared.add_argument("--tier", action="append", choices=["core", "extended", "custom"])
    shared.add_argument("--seed", type=int, default=42)
    shared.add_argument("--metric-option", action="append", default=[])
    shared.add_argument("--html")
    shared.add_argument("--json")
    e = sub.add_parser("evaluate", parents=[shared])
    e.add_argument("--synthetic", required=True)
    e.add_argument("--holdout")
    e.add_argument("--pdf")
    e.add_argument("--mode", default="normalized", choices=["normalized", "actual"])
    b = sub.add_parser("benchmark", parents=[shared])
    b.add_argument("candidates", nargs="+", help="name=path")
    b.add_argument("--by", default="overall")
    b.add_argument("--mode", default="absolute", choices=["absolute", "linear", "normal", "quantile"])
    sub.add_parser("metrics")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "metrics":
        for m in registry.metrics():
            print(f"{m.spec.name}\t{m.spec.c}\t{m.spec.tier}\t{about(m.spec.name)}")
        return 0
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("gaugework").getOrCreate()
        options = {"random_state": args.seed, "metric_options": metric_options(args.metric_option)}
        options |= {"preset": args.preset} if args.preset else {}
        options |= {"tiers": tuple(args.tier)} if args.tier else {}
        real, meta = read_table(spark, args.real), read_metadata(args.metadata) if args.metadata else None
        if args.command == "evaluate":
            holdout = read_table(spark, args.holdout) if args.holdout else None
            report = evaluate(real, read_table(spark, args.synthetic), meta, holdout=holdout, **options)
            html = scorecard_html(report, args.mode)
            if args.json:
                Path(args.json).write_text(report.to_json(), encoding="utf-8")
            if args.html:
                Path(args.html).write_text(html, encoding="utf-8")
            if args.pdf:
                to_pdf(html, args.pdf)
            for c, v in report.aggregated.items():
                print(f"{c}\t{v:.4f}")
            return 0
        tables = {}
        for x in args.candidates:
            name, eq, path = x.partition("=")
            if not eq or not name or name in tables:
                raise GaugeError(f"expected a new name=path, got {x!r}")
            tables[name] = read_table(spark, path)
        result = benchmark(real, tables, meta, **options)
        ranked = result.ranking(args.by, args.mode)
        if args.html:
            Path(args.html).write_text(leaderboard_html(result, args.mode, args.by), encoding="utf-8")
        if args.json:
            Path(args.json).write_text(result.to_json(), encoding="utf-8")
        for i, n, v in ranked:
            print(f"{i}\t{n}\t{v:.4f}")
        for n in result.notes:
            print(f"note: {n}")
        return 0
    except GaugeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
