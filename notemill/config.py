"""Settings of splits, samples and cleanup runs, read from a YAML or JSON file; what a file leaves out keeps its default."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    validation_share: float = 0.1
    seed: int = 42
    size_bins: Mapping[str, int] = field(default_factory=lambda: {"short": 8000, "medium": 20000})
    quotas: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    anchors: Mapping[str, str] = field(default_factory=dict)
    smoke_rows: int = 3
    examples: int = 5


def load(path: str) -> Settings:
    """Settings from a file. Names that are no settings are refused, as they are most often misspelt."""
    text = Path(path).read_text(encoding="utf-8")
    return of(_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text))


def read(spark: SparkSession, path: str) -> Settings:
    """Settings from a file that Spark can read, wherever it is."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return of(_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text))


def of(values: Mapping[str, Any] | None) -> Settings:
    values = dict(values or {})
    unknown = values.keys() - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    return Settings(**values)


def _yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is not installed: write the settings as JSON") from e
    return yaml.safe_load(text)
