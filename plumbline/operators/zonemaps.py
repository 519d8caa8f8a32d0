"""Zone maps: a row for each chunk with minimum, maximum and number of values of each column, and Bloom filters of strings.

Pruning filters the zone map; it never changes results, since rows of chunks that stay are filtered as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.expr import CmpOp, ColumnFilter, CompiledFilter
from plumbline.types import DataType


@dataclass(frozen=True)
class BloomConfig:
    """By rate of false positives or by bits; whichever was set last."""

    fpr: float = 0.01
    bits: int | None = None

    @classmethod
    def of_fpr(cls, fpr: float) -> BloomConfig:
        return cls(fpr=min(0.5, max(0.01, fpr)) if math.isfinite(fpr) else 0.01)

    @classmethod
    def of_bits(cls, bits: int) -> BloomConfig:
        return cls(bits=max(64, int(bits)))

    def sizes(self, items: int) -> tuple[int, int]:
        """Bits of each of the hash functions' slices, and the number of hash functions."""
        items = max(1, items)
        bits = self.bits or max(64, math.ceil(-items * math.log(self.fpr) / math.log(2) ** 2))
        hashes = max(1, round(bits / items * math.log(2)))
        hashes = min(hashes, 16)
        return max(8, bits // hashes), hashes


def positions(value: Column, slice_bits: int, hashes: int) -> list[Column]:
    """The bit of each slice that a string sets."""
    return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(slice_bits)).cast("int") for i in range(hashes)]


def build(rows: DataFrame, schema: dict[str, DataType], bloom: BloomConfig, chunk_size: int) -> DataFrame:
    """chunk_id, rows, and for each column <name>.n with .min and .max or .b0, .b1, ... (sets of bits). One aggregation, partial before the
    shuffle. A float NaN counts as a value but is no minimum or maximum."""
    out = [F.count("*").alias("rows")]
    for name, kind in schema.items():
        c = F.col(f"`{name}`")
        out.append(F.count(c).alias(f"{name}.n"))
        if kind is DataType.String:
            out += [F.collect_set(F.when(c.isNotNull(), p)).alias(f"{name}.b{i}") for i, p in enumerate(positions(c, *bloom.sizes(chunk_size)))]
        else:
            number = F.when(~F.isnan(c), c) if kind.is_float else c
            out += [F.min(number).alias(f"{name}.min"), F.max(number).alias(f"{name}.max")]
    return rows.groupBy("chunk_id").agg(*out)


def keeps(compiled: CompiledFilter, bloom: BloomConfig, chunk_size: int) -> Column:
    """Whether a chunk may hold rows that satisfy the filter, as a column over the zone map."""

    def leaf(f: ColumnFilter) -> Column:
        part = lambda x: F.col(f"`{f.column}.{x}`")
        some = part("n") > 0
        if f.op is CmpOp.Neq:
            return some
        if f.kind is DataType.String:
            bits = positions(F.lit(f.value), *bloom.sizes(chunk_size))
            return some & reduce(Column.__and__, (F.array_contains(part(f"b{i}"), p) for i, p in enumerate(bits)))
        low, high = ColumnFilter(f"{f.column}.min", f.kind, f.op, f.value), ColumnFilter(f"{f.column}.max", f.kind, f.op, f.value)
        if f.op is CmpOp.Eq:
            test = ColumnFilter(low.column, f.kind, CmpOp.Lte, f.value).to_spark() & ColumnFilter(high.column, f.kind, CmpOp.Gte, f.value).to_spark()
        else:
            test = (low if f.op in (CmpOp.Lt, CmpOp.Lte) else high).to_spark()
        return some & F.coalesce(test, F.lit(False))

    return compiled.lower(leaf)
