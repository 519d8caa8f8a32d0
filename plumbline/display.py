"""Text tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from plumbline.functions import datetimes
from plumbline.types import DataType


def width(text: str) -> int:
    """Columns that text takes on a terminal."""
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def cell(value: Any, kind: DataType) -> str:
    if value is None:
        return "NULL"
    if kind.is_float:
        return f"{value:.4f}"
    return datetimes.show(value) if isinstance(value, datetime) else str(value)


def table(headers: Sequence[str], rows: Sequence[Sequence[str]], title: str | None = None) -> str:
    widths = [max(map(width, column)) for column in zip(headers, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda row: "|" + "|".join(f" {x}{' ' * (w - width(x))} " for x, w in zip(row, widths, strict=True)) + "|"
    return "\n".join([*([title] if title else []), rule, line(headers), rule, *map(line, rows), rule]) + "\n"


def facts(title: str, values: dict[str, Any]) -> str:
    return table(["metric", "value"], [[k, f"{v:.3f}" if isinstance(v, float) else str(v)] for k, v in values.items()], title)
