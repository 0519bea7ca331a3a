"""Selectors of series: label conditions as columns, and their text form."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "__name__"
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_METRIC = re.compile(r"\s*([A-Za-z_:][A-Za-z0-9_:.]*)?\s*(?:\{(.*)\})?\s*(?:\[(\d+)([smhd])\])?\s*$", re.DOTALL)
_PART = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')


class SelectorError(ValueError):
    """A selector that can't be read or run."""


@dataclass(frozen=True)
class Matcher:
    """One condition on a label: =, !=, =~ or !~. A regular expression may match anywhere; only the negative ones hold for a missing label."""

    name: str
    op: str
    value: str

    def validate(self) -> Matcher:
        if not self.name:
            raise SelectorError("a matcher needs a label name")
        if self.op not in ("=", "!=", "=~", "!~"):
            raise SelectorError(f"unknown operator {self.op!r}")
        if self.op in ("=~", "!~"):
            try:
                re.compile(self.value)
            except re.error as e:
                raise SelectorError(f"bad regular expression {self.value!r}") from e
        return self

    def column(self, labels: str = "labels", stored_name: bool = False) -> Column:
        """The condition on a map of labels; on the name by the column metric_name, if it is stored, which the scan can prune by."""
        found = F.nullif(F.col("metric_name"), F.lit("")) if stored_name and self.name == NAME else F.try_element_at(F.col(labels), F.lit(self.name))
        if stored_name and self.name == NAME and self.op == "=" and self.value:
            return F.col("metric_name") == self.value
        if self.op == "=":
            return F.coalesce(found == self.value, F.lit(False))
        if self.op == "!=":
            return found.isNull() | (found != self.value)
        if self.op == "=~":
            return F.coalesce(found.rlike(self.value), F.lit(False))
        return found.isNull() | ~found.rlike(self.value)


def metric(name: str) -> Matcher:
    return Matcher(NAME, "=", name)


@dataclass(frozen=True)
class Selector:
    """Conditions that must all hold, and the window of a range selector in ms."""

    matchers: tuple[Matcher, ...] = ()
    window_ms: int | None = None

    @staticmethod
    def parse(text: str) -> Selector:
        """From name{a="b",c!="d",e=~"f",g!~"h"}[5m]; name, braces and window may be left out, units are s, m, h and d."""
        m = _METRIC.match(text)
        if not m or not text.strip():
            raise SelectorError(f"can't read {text!r}")
        name, inside, n, unit = m.groups()
        found = [metric(name)] if name else []
        at = 0
        inside = (inside or "").strip()
        while at < len(inside):
            part = _PART.match(inside, at)
            if not part:
                raise SelectorError(f"can't read {inside[at:]!r}")
            found.append(Matcher(part[1], part[2], re.sub(r"\\(.)", r"\1", part[3])))
            at = part.end()
        if not found:
            raise SelectorError("a selector needs a name or a matcher")
        return Selector(tuple(found), int(n) * UNITS[unit] if n else None).validate()

    @staticmethod
    def of_pairs(pairs: list[str]) -> Selector:
        """From "label=value" texts, as in repeated request parameters."""
        found = []
        for p in pairs:
            name, sign, value = p.partition("=")
            if not sign or not name:
                raise SelectorError(f"not label=value: {p!r}")
            found.append(Matcher(name, "=", value))
        return Selector(tuple(found))

    def validate(self) -> Selector:
        for m in self.matchers:
            m.validate()
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        stored = "metric_name" in df.columns
        return reduce(lambda d, m: d.filter(m.column(stored_name=stored)), self.validate().matchers, df)
