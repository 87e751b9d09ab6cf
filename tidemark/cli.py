"""Commands: adapt, analyze, drift, update-prices."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from . import registry


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _write(text: str | Iterable[str], path: str | None) -> None:
    parts = [text] if isinstance(text, str) else text
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.writelines(parts)
    else:
        sys.stdout.writelines(parts)


def _drift_lines(hints: Iterable[dict], form: str) -> Iterator[str]:
    """A JSON array, a hint a line, or text."""
    if form == "json":
        yield "["
        for i, h in enumerate(hints):
            yield (",\n" if i else "\n") + json.dumps(h)
        yield "\n]\n"
        return
    yield "Differences between continued tasks are hints, not verdicts.\n"
    for h in hints:
        worst = max((c["distance"] for c in h["content_distances"]), default=None)
        yield f"{h['predecessor']} -> {h['successor']}: shape distance {h['shape_distance']} ({h['shape_fraction']:.0%}), {len(h['added'])} added, {len(h['removed'])} removed, {len(h['substituted'])} substituted" + (f", worst content distance {worst}" if worst is not None else "") + "\n"


def _text_of(place: str) -> str:
    if place.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(place, timeout=30) as answer:
            return answer.read().decode("utf-8")
    with open(place, encoding="utf-8") as file:
        return file.read()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    adapt = commands.add_parser("adapt", help="telemetry to events")
    adapt.add_argument("path")
    adapt.add_argument("--out", required=True)
    adapt.add_argument("--source")
    adapt.add_argument("--prices", help="price file for calls without a reported cost")
    adapt.add_argument("--price-override", help="price file whose models take precedence")
    analyze = commands.add_parser("analyze", help="events to a report")
    analyze.add_argument("path")
    analyze.add_argument("--analysis", default="waste")
    analyze.add_argument("--format", default="text")
    analyze.add_argument("--lenient", action="store_true")
    analyze.add_argument("--max-reasons", type=int, default=20)
    analyze.add_argument("--calls-per-day", type=int, default=1000)
    analyze.add_argument("--out")
    drift = commands.add_parser("drift", help="how continued tasks differ")
    drift.add_argument("path")
    drift.add_argument("--format", choices=("text", "json"), default="text")
    drift.add_argument("--out")
    update = commands.add_parser("update-prices", help="a public listing of costs to a price file")
    update.add_argument("listing", help="file or address of the listing")
    update.add_argument("--out", required=True)
    receive = commands.add_parser("collect", help="receive OTLP over HTTP, one file a request")
    receive.add_argument("--out", required=True)
    receive.add_argument("--host", default="127.0.0.1")
    receive.add_argument("--port", type=int, default=4318)
    args = parser.parse_args(argv)
    if args.command == "collect":
        from .sources.collector import serve

        serve(args.out, args.host, args.port)
        return 0

    from .sources import jsonl

    spark = _session()
    try:
        if args.command == "adapt":
            from .functions.pricing import age_note, load_overlaid
            from .sources.detect import adapt as convert
            from .sources.summary import lines

            prices, made = load_overlaid(args.prices, args.price_override)
            events = convert(spark, args.path, args.source, prices, tuple(registry.sources().found.values()))
            jsonl.write_events(jsonl.with_source_path(events, args.path), args.out)
            sys.stderr.writelines(f"{line}\n" for line in lines(jsonl.read_events(spark, args.out, lenient=True).events))
            if prices and (note := age_note(made)):
                sys.stderr.write(f"{note}\n")
            return 0
        if args.command == "update-prices":
            from .functions.pricing import read_listing, write_prices

            sys.stdout.write(f"{write_prices(read_listing(spark, _text_of(args.listing)), args.out)} models\n")
            return 0
        loaded = jsonl.read_events(spark, args.path, lenient=getattr(args, "lenient", False))
        if args.command == "analyze":
            analysis = registry.analyses().get(args.analysis)().run(loaded.events)
            _write(registry.formats().get(args.format)(analysis, max_reasons=args.max_reasons, calls_per_day=args.calls_per_day), args.out)
            return 0
        from .operators.drift import drift_hints
        from .operators.task_graph import task_edges

        hints = drift_hints(loaded.events, task_edges(loaded.events)).orderBy("predecessor", "successor")
        # A partition at a time: there may be as many hints as tasks.
        _write(_drift_lines((r.asDict(True) for r in hints.toLocalIterator()), args.format), args.out)
        return 0
    except jsonl.BadRows as error:
        sys.stderr.write(f"{error}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
