"""Filters: the AND of typed equality and closed range predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.metadata import Field, Value


@dataclass(frozen=True)
class Eq:
    key: str
    value: Value

    def column(self, df: DataFrame) -> Column:
        return Field(df, self.key).equals(self.value)


@dataclass(frozen=True)
class Range:
    key: str
    min: float | None = None
    max: float | None = None

    def column(self, df: DataFrame) -> Column:
        return Field(df, self.key).within(self.min, self.max)


@dataclass(frozen=True)
class Filter:
    """All of ``must``; an empty filter matches every record, also one without metadata."""

    must: tuple[Eq | Range, ...] = field(default_factory=tuple)

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [p.column(df) for p in self.must], F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column(df)) if self.must else df

    def eq_keys(self) -> list[str]:
        return [p.key for p in self.must if isinstance(p, Eq)]

    @classmethod
    def from_json(cls, text: str | dict) -> Filter:
        """``{"must": [{"op": "eq", "key": .., "value": ..}, {"op": "range", "key": .., "min": .., "max": ..}]}``"""
        data = json.loads(text) if isinstance(text, str) else text
        must: list[Eq | Range] = []
        for p in data.get("must", []):
            if p["op"] == "eq":
                if not isinstance(p["value"], (bool, int, float, str)):
                    raise ValueError(f"not a metadata value: {p['value']!r}")
                must.append(Eq(p["key"], p["value"]))
            elif p["op"] == "range":
                must.append(Range(p["key"], p.get("min"), p.get("max")))
            else:
                raise ValueError(f"no such predicate: {p['op']}")
        return cls(tuple(must))

    def to_json(self) -> str:
        return json.dumps({"must": [{"op": "eq", "key": p.key, "value": p.value} if isinstance(p, Eq) else {"op": "range", "key": p.key, "min": p.min, "max": p.max} for p in self.must]})
