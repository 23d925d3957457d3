"""Site configuration: detection rules and extraction specs per site."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from speclake.sources.default_sites import SITES

LOAD_PRIORITY = 100
DETECT_PRIORITY = 999
GENERIC = "generic"


@dataclass(frozen=True)
class DetectRule:
    kind: str
    arg: str


@dataclass(frozen=True)
class Site:
    vendor: str
    name: str
    priority: int | None
    rules: tuple[DetectRule, ...]
    specs: tuple[dict, ...] = field(hash=False)


class Sites:
    """All sites, in load order."""

    def __init__(self, entries: dict[str, dict]) -> None:
        sites = [
            Site(
                vendor=vendor,
                name=entry.get("name", vendor),
                priority=entry.get("priority"),
                rules=tuple(
                    DetectRule(*_rule_kind(rule)) for rule in entry.get("detect") or []
                ),
                specs=tuple(entry.get("specs") or []),
            )
            for vendor, entry in entries.items()
        ]
        self._sites = sorted(
            sites, key=lambda s: LOAD_PRIORITY if s.priority is None else s.priority
        )

    def all(self) -> list[Site]:
        return list(self._sites)

    def rules_in_order(self) -> list[tuple[str, DetectRule]]:
        """Detection order.  A site without priority comes last here, though it
        loads at 100; ties keep load order; the generic entry never detects."""
        ordered = sorted(
            (s for s in self._sites if s.vendor != GENERIC),
            key=lambda s: DETECT_PRIORITY if s.priority is None else s.priority,
        )
        return [(site.vendor, rule) for site in ordered for rule in site.rules]

    def spec_source(self, vendor: str) -> Site:
        """The site, or the generic entry for an unknown one."""
        by_vendor = {site.vendor: site for site in self._sites}
        empty = Site(vendor, vendor, None, (), ())
        return by_vendor.get(vendor, by_vendor.get(GENERIC, empty))

    # -- as tables --------------------------------------------------------
    def vendors(self, spark: SparkSession) -> DataFrame:
        rows = [(s.vendor, s.name, s.priority) for s in self._sites]
        return spark.createDataFrame(rows, "vendor STRING, name STRING, priority INT")

    def detect_rules(self, spark: SparkSession) -> DataFrame:
        rows = [
            (vendor, i, rule.kind, rule.arg)
            for i, (vendor, rule) in enumerate(self.rules_in_order())
        ]
        return spark.createDataFrame(
            rows, "vendor STRING, rule_ord INT, kind STRING, arg STRING"
        )

    def specs(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s.vendor, i, spec.get("type"), json.dumps(spec, ensure_ascii=False))
            for s in self._sites
            for i, spec in enumerate(s.specs)
        ]
        return spark.createDataFrame(
            rows, "vendor STRING, spec_ord INT, type STRING, params STRING"
        )


def _rule_kind(rule: dict) -> tuple[str, str]:
    for kind in ("id", "selector", "class_contains", "text_contains"):
        if kind in rule:
            return kind, str(rule[kind])
    kind, arg = next(iter(rule.items()))
    return str(kind), str(arg)


_BUILT_IN: list[Sites] = []


def load_sites(path: str | Path | None = None) -> Sites:
    """Sites of a YAML or JSON file, or the built-in ones."""
    if path is None:
        if not _BUILT_IN:
            _BUILT_IN.append(Sites(SITES))
        return _BUILT_IN[0]
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no site configuration at {file}")
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        return Sites(json.loads(text))
    try:
        import yaml
    except ImportError as problem:
        raise RuntimeError("reading a YAML site file needs PyYAML; use JSON") from problem
    return Sites(yaml.safe_load(text))
