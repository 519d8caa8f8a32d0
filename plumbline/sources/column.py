"""Typed nullable columns built value by value: for small data; large data comes as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np

from plumbline.functions import datetimes
from plumbline.types import ColumnError, ColumnTypeMismatch, DataType

#: Python and NumPy types that a column takes; nothing is widened.
ACCEPTS = {
    DataType.Int32: (int, np.int32),
    DataType.Int64: (int, np.int64),
    DataType.Float32: (float, np.float32),
    DataType.Float64: (float, np.float64),
    DataType.String: (str,),
}
REFUSES = {DataType.Float32: (np.float64,), DataType.Float64: (), DataType.Int32: (bool,), DataType.Int64: (bool,), DataType.String: ()}


@dataclass(frozen=True)
class ColumnValue:
    """A value whose type is said and not told from Python's: of a datetime, milliseconds since the epoch or None."""

    kind: DataType
    value: Any

    @classmethod
    def datetime(cls, millis: int | None) -> ColumnValue:
        return cls(DataType.DateTime, millis)

    @classmethod
    def datetime_str(cls, text: str | None) -> ColumnValue:
        return cls(DataType.String, text)


class Column:
    def __init__(self, name: str, dtype: DataType) -> None:
        self.name, self.dtype = name, dtype
        self._values: list[Any] = []
        self._format: str | None = None

    def with_datetime_fmt(self, fmt: str) -> Column:
        """A strftime format for texts that are pushed from now on."""
        self._format = fmt
        return self

    def push(self, value: Any) -> None:
        self._values.append(self._checked(value))

    def from_values(self, values: Iterable[Any]) -> Column:
        """Append all values, or none if one is refused."""
        checked = [self._checked(v) for v in values]
        self._values += checked
        return self

    def _checked(self, value: Any) -> Any:
        kind = None
        if isinstance(value, ColumnValue):
            kind, value = value.kind, value.value
            if kind is not self.dtype and not (self.dtype is DataType.DateTime and kind is DataType.String):
                raise self._mismatch(kind.name)
        if value is None:
            return None
        if self.dtype is DataType.DateTime:
            if kind is DataType.DateTime:
                return int(value)
            if not isinstance(value, str):
                raise self._mismatch(type(value).__name__)
            return datetimes.parse_as(value, self._format)
        if not isinstance(value, ACCEPTS[self.dtype]) or isinstance(value, (bool, *REFUSES[self.dtype])):
            raise self._mismatch(type(value).__name__)
        if self.dtype.is_integer:
            bits = 31 if self.dtype is DataType.Int32 else 63
            if not -(2**bits) <= value < 2**bits:
                raise self._mismatch("a wider integer")
            return int(value)
        if self.dtype is DataType.Float32:
            try:
                return struct.unpack("<f", struct.pack("<f", value))[0]
            except OverflowError:
                raise self._mismatch("a wider float") from None
        return float(value) if self.dtype is DataType.Float64 else str(value)

    def _mismatch(self, got: str) -> ColumnError:
        return ColumnTypeMismatch(f"column '{self.name}' holds {self.dtype.name}, got {got}")

    def __len__(self) -> int:
        return len(self._values)

    def is_empty(self) -> bool:
        return not self._values

    def null_mask(self) -> list[bool]:
        return [v is None for v in self._values]

    def values(self) -> list[Any]:
        """Values, datetimes in milliseconds, None for nulls."""
        return list(self._values)

    def values_of(self, dtype: DataType) -> list[Any] | None:
        """The values if the column has that type, else None."""
        return self.values() if dtype is self.dtype else None

    def i32_values(self) -> list[Any] | None:
        return self.values_of(DataType.Int32)

    def i64_values(self) -> list[Any] | None:
        return self.values_of(DataType.Int64)

    def f32_values(self) -> list[Any] | None:
        return self.values_of(DataType.Float32)

    def f64_values(self) -> list[Any] | None:
        return self.values_of(DataType.Float64)

    def string_values(self) -> list[Any] | None:
        return self.values_of(DataType.String)

    def datetime_values(self) -> list[Any] | None:
        return self.values_of(DataType.DateTime)

    def spark_values(self) -> list[Any]:
        return [None if v is None else datetimes.from_millis(v) for v in self._values] if self.dtype is DataType.DateTime else self.values()

    def head_text(self, n: int = 5) -> str:
        lines = [f"Column: {self.name} ({self.dtype.name})"]
        for i, v in enumerate(self._values[:n]):
            if v is None:
                shown = "NULL"
            elif self.dtype.is_float:
                shown = f"{v:.4f}"
            elif self.dtype is DataType.String:
                shown = f'"{v}"'
            else:
                shown = f"{datetimes.show(datetimes.from_millis(v))} ({v})" if self.dtype is DataType.DateTime else str(v)
            lines.append(f"  [{i}]: {shown}")
        if len(self) > n:
            lines.append(f"  ... ({len(self) - n} more rows)")
        return "\n".join(lines)

    def head(self, n: int = 5) -> None:
        print(self.head_text(n))
