"""Settings from a TOML file, and results as JSON or text."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    cache_budget_mb: int = 2048
    page_size: int = 50
    face_threshold: float = 0.5
    shared_zones: bool = True
    source: str = "thumb"

    @property
    def cache_budget(self) -> int:
        return self.cache_budget_mb << 20

    def changed(self, key: str, text: str) -> Settings:
        """With a key read from text as its kind; an unknown key is an error."""
        kinds = {f.name: type(f.default) for f in fields(self)}
        if key not in kinds:
            raise KeyError(key)
        return replace(self, **{key: text.lower() in _TRUE if kinds[key] is bool else kinds[key](text)})


def load(path: str | Path) -> Settings:
    """The file's settings over the defaults; without a file the defaults."""
    p = Path(path)
    return replace(Settings(), **tomllib.loads(p.read_text())) if p.exists() else Settings()


def save(settings: Settings, path: str | Path) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("".join(f"{f.name} = {json.dumps(getattr(settings, f.name))}\n" for f in sorted(fields(settings), key=lambda f: f.name)))


def emit(rows: DataFrame, out: IO[str], line: Callable[[dict], str] | None = None) -> int:
    """Write rows as one JSON object a line or, with `line`, as text; rows come to the driver a partition at a time."""
    n = 0
    if line is None:
        for r in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
            out.write(r["line"] + "\n")
            n += 1
        return n
    for r in rows.toLocalIterator():
        out.write(line(r.asDict(recursive=True)) + "\n")
        n += 1
    return n
