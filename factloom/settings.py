"""Settings of the stages: defaults, overlaid by the nearest settings file up the folders.

The file is JSON with the fields of ``Settings``, any of which may be left out, for example
``{"textual": {"word_window": 9}, "tabular": {"row_ngrams": 1}}``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

FILE, PARENTS = ".factloom.json", 25


@dataclass(frozen=True)
class Textual:
    """Tokens either way of a span that window and word features look at, and which window features there are."""

    window: int = 3
    isolated: bool = True
    combinations: bool = True
    word_window: int = 7


@dataclass(frozen=True)
class Tabular:
    """The token attributes that tabular features name, the longest n-grams of each kind, and whether distances lose their signs."""

    attributes: tuple[str, ...] = ("words",)
    cell_ngrams: int = 2
    head_ngrams: int = 2
    row_ngrams: int = 2
    col_ngrams: int = 2
    absolute_rows: bool = False
    absolute_cols: bool = False


@dataclass(frozen=True)
class Learning:
    regularisation: float = 0.0
    iterations: int = 100
    threshold: float = 0.5


@dataclass(frozen=True)
class Settings:
    textual: Textual = field(default_factory=Textual)
    tabular: Tabular = field(default_factory=Tabular)
    learning: Learning = field(default_factory=Learning)


def overlay(settings: Any, changes: dict[str, Any]) -> Any:
    """The settings with some of their fields changed; an unknown field is an error."""
    known = {f.name for f in fields(settings)}
    if unknown := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for name, value in changes.items():
        old = getattr(settings, name)
        new[name] = overlay(old, value) if is_dataclass(old) else tuple(value) if isinstance(old, tuple) else value
    return replace(settings, **new)


def load(folder: str | Path = ".") -> Settings:
    """The defaults, overlaid by the first settings file in the folder or up to ``PARENTS`` folders above it."""
    at = Path(folder).resolve()
    for place in [at, *at.parents][: PARENTS + 1]:
        if (place / FILE).is_file():
            return overlay(Settings(), json.loads((place / FILE).read_text()))
    return Settings()
