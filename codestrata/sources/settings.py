"""Project settings (TOML) and baselines (JSON): small files of people, read and written on the driver."""

from __future__ import annotations

import datetime as dt
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators.findings import Layer, parse_rules

BASELINE_VERSION = 1
BASELINE_SCHEMA = "scan_id long, id string, kind string, severity string, headline string, paths array<string>, note string"


@dataclass
class Settings:
    """Globs and layering rules of a project."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    entrypoints: list[str] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)

    def invalid_rules(self) -> list[str]:
        return parse_rules(self.rules, self.layers)[1]


def load_settings(path: str) -> Settings:
    """Settings of a file; of a missing one the defaults. Unknown keys are an error. Rules of layers join the others."""
    if not Path(path).exists():
        return Settings()
    raw = tomllib.loads(Path(path).read_text())
    unknown = set(raw) - {"include", "exclude", "entrypoints", "layers", "rules"}
    layers = raw.get("layers", [])
    for layer in layers:
        unknown |= set(layer) - {"name", "paths", "rules"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = [*raw.get("rules", []), *(r for layer in layers for r in layer.get("rules", []))]
    return Settings(raw.get("include", []), raw.get("exclude", []), raw.get("entrypoints", []), [Layer(x["name"], tuple(x["paths"])) for x in layers], rules)


def save_settings(path: str, settings: Settings) -> None:
    text = "".join(f"{key} = {json.dumps(value)}\n" for key, value in (("include", settings.include), ("exclude", settings.exclude), ("entrypoints", settings.entrypoints), ("rules", settings.rules)) if value)
    text += "".join(f"\n[[layers]]\nname = {json.dumps(layer.name)}\npaths = {json.dumps(list(layer.globs))}\n" for layer in settings.layers)
    Path(path).write_text(text)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The accepted findings of a file, None where there is none; a newer format is an error."""
    if not Path(path).exists():
        return None
    raw = json.loads(Path(path).read_text())
    if raw["version"] > BASELINE_VERSION:
        raise ValueError(f"the baseline is of version {raw['version']}, newer than {BASELINE_VERSION}")
    return spark.createDataFrame([(e["scan_id"], e["id"], e["kind"], e["severity"], e["headline"], e["paths"], e.get("note")) for e in raw["entries"]], BASELINE_SCHEMA)


def save_baseline(path: str, baseline: DataFrame) -> None:
    """Write a baseline, sorted by id. It holds what people accepted one by one or by rule, a file meant to be read."""
    entries = [r.asDict() for r in baseline.dropDuplicates(["scan_id", "id"]).orderBy("id", "scan_id").toLocalIterator()]
    Path(path).write_text(json.dumps({"version": BASELINE_VERSION, "saved": dt.date.today().isoformat(), "entries": entries}, indent=1, ensure_ascii=False) + "\n")
