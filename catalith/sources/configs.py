"""Configuration from JSON files: categories with their schema and golden sample, and the validated settings of the engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Files of a category's folder.
KINDS = ("config", "schema", "sample")


class CategoryConfigs:
    """Folder with one folder for each category slug, holding config.json, schema.json, sample.json. Files are read once and kept; misses too."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self._held: dict[tuple[str, str], Any] = {}

    def get(self, slug: str, kind: str = "config") -> Any:
        """The content, or None if there is no such file."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if (slug, kind) not in self._held:
            path = self.folder / slug / f"{kind}.json"
            self._held[slug, kind] = json.loads(path.read_text()) if path.is_file() else None
        return self._held[slug, kind]

    def put(self, slug: str, kind: str, content: Any) -> None:
        """Writes the file and holds the new content."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        path = self.folder / slug / f"{kind}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(content, ensure_ascii=False, indent=2))
        self._held[slug, kind] = content

    def reload(self) -> None:
        self._held.clear()

    def slugs(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if p.is_dir()) if self.folder.is_dir() else []

    def table(self, spark: SparkSession) -> DataFrame:
        """slug, key, type, order, low, high of every declared spec: small enough to broadcast, as it is one row for a schema key."""
        rows = []
        for slug in self.slugs():
            for key, rule in ((self.get(slug, "schema") or {}).get("properties") or {}).items():
                meta = rule.get("meta") or {}
                number = lambda x: None if x is None else float(x)
                rows.append((slug, key, rule.get("type", "string"), meta.get("order"), number(meta.get("min")), number(meta.get("max"))))
        return spark.createDataFrame(rows, "slug string, key string, type string, order int, low double, high double")


@dataclass(frozen=True)
class Settings:
    """The settings of resolution and scheduling; every one has a default and a least and greatest value."""

    threshold: float = field(default=0.4, metadata={"range": (0, 1)})
    vector_limit: int = field(default=5, metadata={"range": (1, 1000)})
    max_candidates: int = field(default=50, metadata={"range": (1, 10_000)})
    accept: int = field(default=70, metadata={"range": (0, 100)})
    accept_strict: int = field(default=80, metadata={"range": (0, 100)})
    gap: int = field(default=5, metadata={"range": (0, 100)})
    gap_anchored: int = field(default=10, metadata={"range": (0, 100)})
    pairs_per_run: int = field(default=100, metadata={"range": (1, 1_000_000)})
    merges_per_run: int = field(default=50, metadata={"range": (0, 1_000_000)})


def load_settings(folder: str) -> Settings:
    """Settings from the JSON objects of all *.json files of a folder, later names winning; empty strings and nulls count as not given.

    All faults are raised together: unknown keys, wrong types, values out of range.
    """
    given: dict[str, Any] = {}
    for path in sorted(Path(folder).glob("*.json")):
        given |= {k: v for k, v in json.loads(path.read_text()).items() if v not in (None, "")}
    known = {f.name: f for f in fields(Settings)}
    wrong = [f"{k}: unknown" for k in given if k not in known]
    for k, v in given.items():
        if k in known:
            number = isinstance(v, (int, float)) and not isinstance(v, bool) and (isinstance(known[k].default, float) or isinstance(v, int))
            low, high = known[k].metadata["range"]
            if not number:
                wrong.append(f"{k}: not a number" if known[k].type == "float" else f"{k}: not a whole number")
            elif not low <= v <= high:
                wrong.append(f"{k}: not from {low} to {high}")
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))
    return Settings(**given)
