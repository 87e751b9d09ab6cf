"""Plugins: sources, analyses and report formats by name; built-in ones first, in a fixed order."""

from __future__ import annotations

import logging
from importlib.metadata import entry_points

from .plans.waste import WasteAnalysis
from .report import render

log = logging.getLogger(__name__)
GROUPS = {"sources": "tidemark.sources", "analyses": "tidemark.analyses", "formats": "tidemark.formats"}


class Registry:
    """Named plugins of one kind; a second one of the same name is an error, one that can't be loaded is logged."""

    def __init__(self, kind: str, built_in: dict):
        self.kind, self.found = kind, dict(built_in)

    def add(self, name: str, plugin) -> None:
        if name in self.found:
            raise ValueError(f"two {self.kind} are called {name}")
        self.found[name] = plugin

    def load(self) -> Registry:
        for point in entry_points(group=GROUPS[self.kind]):
            try:
                plugin = point.load()
            except Exception as error:  # a broken plugin must not stop the others
                log.warning("%s plugin %s can't be loaded: %s", self.kind, point.name, error)
                continue
            self.add(getattr(plugin, "NAME", None) or getattr(plugin, "name", point.name), plugin)
        return self

    def get(self, name: str):
        if name not in self.found:
            raise KeyError(f"no {self.kind} called {name}; there are {', '.join(sorted(self.found))}")
        return self.found[name]


def sources() -> Registry:
    """Sources: objects with NAME, convert(docs), and SIGNALS or detect(docs) for OTLP documents, or load(spark, path) for files of their own.

    One with PRICED gets a price table: convert(docs, prices).
    """
    from .sources.detect import SOURCES

    return Registry("sources", {s.NAME: s for s in SOURCES}).load()


def analyses() -> Registry:
    return Registry("analyses", {WasteAnalysis.name: WasteAnalysis}).load()


def formats() -> Registry:
    return Registry("formats", {"text": render.to_text, "json": render.to_json, "html": render.to_html}).load()
