"""Which source a folder of telemetry comes from, and its events."""

from __future__ import annotations

from types import ModuleType, SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coding_cli, cowork, openclaw, openclaw_localtrace, opencode, openinference, otlp, pi

#: In order of precedence.
SOURCES: tuple[ModuleType, ...] = (coding_cli, cowork, openclaw, openclaw_localtrace, openinference)


class UnknownSource(ValueError):
    """No source claims the documents."""


def records(docs: DataFrame) -> DataFrame:
    """Spans and log records alike: rows (kind, name, attributes, resource); a log has no name."""
    spans = otlp.spans(docs).select(F.lit("span").alias("kind"), "name", "attributes", "resource")
    return spans.unionByName(otlp.logs(docs).select(F.lit("log").alias("kind"), F.lit(None).cast("string").alias("name"), "attributes", "resource"))


def signals(docs: DataFrame, sources: tuple[ModuleType, ...] = SOURCES) -> DataFrame:
    """One row: for each signal of each source whether a record shows it, and residual, all from one pass.

    residual: there are log records, and all have one of the documented event names.
    """
    row = SimpleNamespace(**{c: F.col(c) for c in ("kind", "name", "attributes", "resource")})
    claims = [F.coalesce(F.bool_or(test(row)), F.lit(False)).alias(f"{s.NAME}:{i}") for s in sources for i, (_, test) in enumerate(s.SIGNALS)]
    documented = F.coalesce(row.attributes.getItem("event.name").isin(*cowork.EVENTS), F.lit(False))
    residual = F.coalesce(F.bool_and(F.when(row.kind == "log", documented)), F.lit(False))
    return records(docs).agg(*claims, residual.alias("residual"))


def detect(docs: DataFrame, sources: tuple = SOURCES) -> tuple[ModuleType, str]:
    """(source, why): the first that claims the documents; logs of documented names only are Cowork's.

    A source has SIGNALS, pairs of a reason and a test of a record, or a detect(docs) of its own that returns the reason.
    """
    own = tuple(s for s in sources if hasattr(s, "SIGNALS"))
    found = signals(docs, own).head()
    for source in sources:
        if source in own:
            why = next((reason for i, (reason, _) in enumerate(source.SIGNALS) if found[f"{source.NAME}:{i}"]), None)
        else:
            why = source.detect(docs)
        if why:
            return source, why
    if found["residual"]:
        return cowork, "all event names are documented ones"
    counts = docs.selectExpr("count_if(is_trace) as traces", "count_if(is_log) as logs", "count_if(is_metrics) as metrics", "count(*) as documents").head()
    raise UnknownSource(f"no source claims {counts['documents']} documents ({counts['traces']} traces, {counts['logs']} logs, {counts['metrics']} metrics)")


#: Sources with files of their own, asked only if nothing is OTLP.
NATIVE: tuple[ModuleType, ...] = (opencode, pi)


def _events(source, docs: DataFrame, prices: dict | None) -> DataFrame:
    """A source's events; one that is PRICED takes a price table for calls without a cost."""
    return source.convert(docs, prices) if getattr(source, "PRICED", False) else source.convert(docs)


def load_native(spark: SparkSession, path: str, sources: tuple) -> tuple[object, DataFrame] | None:
    """The first source that claims a folder as its own format, with what it read there.

    Such a source has load(spark, path), which looks for its mark and returns None without it; nothing is converted for that.
    """
    for source in sources:
        if hasattr(source, "load") and (found := source.load(spark, path)) is not None:
            return source, found
    return None


def adapt(spark: SparkSession, path: str, source: str | None = None, prices: dict | None = None, sources: tuple = SOURCES) -> DataFrame:
    """Events of a folder of OTLP documents, or of a source's own files; prices has entries as pricing.load_overlaid gives.

    Sources of plugins come first, in both ways: what they load themselves, and what they recognise.
    """
    every = (*sources, *(s for s in NATIVE if s not in sources))
    named = next((s for s in every if s.NAME == source), None)
    if source and named is None:
        raise UnknownSource(f"no source called {source}")
    if not path.endswith(opencode.DATABASES) and not (named and hasattr(named, "load")):
        docs = otlp.read_documents(spark, path)
        if named or not docs.where("is_trace or is_log or is_metrics").isEmpty():
            return _events(named or detect(docs, tuple(s for s in sources if hasattr(s, "SIGNALS") or hasattr(s, "detect")))[0], docs, prices)
    found = load_native(spark, path, (named,) if named else every)
    if found is None:
        raise UnknownSource(f"no source claims anything in {path}")
    return _events(*found, prices)
