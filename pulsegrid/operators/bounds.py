"""Detector settings as columns: one grammar for all trains, or a table with values of single trains."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.sources.shared import small

#: What the names of joined settings begin with, and the ends of settings that are two numbers.
PREFIX, ENDS = "_g_", ("low", "high")


def fields() -> dict[str, object]:
    """Names of the settings that a table may hold, with their defaults; a setting of two numbers is two columns."""
    out: dict[str, object] = {}
    for f in dataclasses.fields(Grammar):
        out |= {f"{f.name}_{end}": v for end, v in zip(ENDS, f.default, strict=True)} if isinstance(f.default, tuple) else {f.name: f.default}
    return out


class Bounds:
    """Settings by name, as columns. Of a Grammar they are literals. Of a table (train and any settings) they are columns that on() joins to rows by train; what the table leaves out, trains that it lacks
    and nulls have the value of base. A table has one row a train."""

    def __init__(self, given: Grammar | DataFrame | None = None, base: Grammar | None = None):
        self._base = given if isinstance(given, Grammar) else base or Grammar()
        self._table, self._own = None, []
        if isinstance(given, DataFrame):
            self._own = [c for c in given.columns if c != "train"]
            unknown = sorted(set(self._own) - set(fields()))
            if unknown or "train" not in given.columns:
                raise ValueError(f"unknown settings: {', '.join(unknown)}" if unknown else "settings need a train")
            self._table = small(given.select("train", *[F.col(c).alias(PREFIX + c) for c in self._own]))

    def __getattr__(self, name: str) -> Column | tuple[Column, Column]:
        value = getattr(self._base, name)
        if isinstance(value, tuple):
            return tuple(self._one(f"{name}_{end}", v) for end, v in zip(ENDS, value, strict=True))
        return self._one(name, value)

    def _one(self, name: str, value: object) -> Column:
        default = F.lit(value) if value is not None else F.lit(None).cast("double")
        return F.coalesce(F.col(PREFIX + name), default) if name in self._own else default

    def on(self, df: DataFrame) -> DataFrame:
        """df with the settings of its trains."""
        return df if self._table is None or any(c.startswith(PREFIX) for c in df.columns) else df.join(self._table, "train", "left")

    def off(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith(PREFIX)])

    def most(self, name: str) -> float:
        """The greatest value of a setting, for frames of windows."""
        value = getattr(self._base, name)
        if name not in self._own:
            return value
        found = self._table.agg(F.max(PREFIX + name)).first()[0]
        return value if found is None else max(value, found)

    def given(self, name: str) -> bool:
        """Is there any value at all?"""
        return name in self._own or getattr(self._base, name) is not None
