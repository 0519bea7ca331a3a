"""Log and span search: filters, newest-first pages and cursors."""

from __future__ import annotations

import base64
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarnlight.functions.scalars import duration_ns, last_entries, utc_seconds
from tarnlight.functions.tokens import has_all_stems, has_all_tokens, stored_has_all

DEFAULT_LIMIT, MAX_LIMIT = 100, 100_000
EPOCH, DAY_NS = date(1970, 1, 1), 86_400_000_000_000


class QueryError(ValueError):
    """A query that can't be run as it is."""


@dataclass(frozen=True)
class Cursor:
    """The last row of a page; the next page has the rows older than it."""

    ts_ns: int
    id: bytes

    def encode(self) -> str:
        return base64.urlsafe_b64encode(struct.pack(">q", self.ts_ns) + self.id).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        except ValueError as e:
            raise QueryError(f"bad cursor: {text!r}") from e
        if len(raw) != 24:
            raise QueryError(f"bad cursor: {text!r}")
        return Cursor(struct.unpack(">q", raw[:8])[0], raw[8:])

    def before(self, ts: str, row_id: str = "id") -> Column:
        """Rows that come after this one in the order newest first, greatest id first."""
        return (F.col(ts) < self.ts_ns) | ((F.col(ts) == self.ts_ns) & (F.col(row_id) < F.lit(self.id)))


@dataclass(frozen=True)
class _Query:
    start_ns: int | None = None
    end_ns: int | None = None
    services: Sequence[str] = ()
    trace_id: str | None = None
    attrs: Mapping[str, str] = field(default_factory=dict)
    limit: int = 0
    cursor: str | None = None

    def validate(self):
        """The query with its limit filled in, or QueryError."""
        if self.limit < 0:
            raise QueryError("limit must not be negative")
        if self.limit > MAX_LIMIT:
            raise QueryError(f"limit must not exceed {MAX_LIMIT}")
        if self.start_ns is not None and self.end_ns is not None and self.start_ns > self.end_ns:
            raise QueryError("the time range ends before it starts")
        if self.cursor:
            Cursor.decode(self.cursor)
        return replace(self, limit=self.limit or DEFAULT_LIMIT)

    def _common(self, ts: str) -> list[Column]:
        out = []
        if self.start_ns is not None:
            out.append(F.col(ts) >= self.start_ns)
        if self.end_ns is not None:
            out.append(F.col(ts) <= self.end_ns)
        if self.services:
            out.append(F.col("service").isin(*self.services))
        if self.trace_id and self.trace_id.strip("0"):
            out.append(F.col("trace_id") == self.trace_id)
        return out + [has_attr(k, v) for k, v in self.attrs.items()]


def has_attr(key: str, value: str) -> Column:
    """Whether any pair of attrs is this one; a key may stand there several times."""
    return F.exists("attrs", lambda a: (a["key"] == key) & (a["value"] == value))


@dataclass(frozen=True)
class LogQuery(_Query):
    """Conditions on logs; all that are given must hold. Lists hold alternatives and tell capitals from small letters.

    text is compared by stems, exact_text by the tokens as they stand.
    """

    levels: Sequence[str] = ()
    hosts: Sequence[str] = ()
    text: str | None = None
    exact_text: str | None = None

    def conditions(self) -> list[Column]:
        out = self._common("ts_ns")
        if self.levels:
            out.append(F.col("level").isin(*self.levels))
        if self.hosts:
            out.append(F.col("host").isin(*self.hosts))
        if self.exact_text:
            out.append(has_all_tokens(F.col("body"), self.exact_text))
        return out

    def text_condition(self, stored: bool) -> list[Column]:
        """The condition on the text, by the column tokens where it is stored."""
        if not self.text:
            return []
        return [stored_has_all(F.col("tokens"), self.text) if stored else has_all_stems(F.col("body"), self.text)]


@dataclass(frozen=True)
class SpanQuery(_Query):
    """Conditions on spans; times are those of the start, durations in nanoseconds, 0 for no bound."""

    operations: Sequence[str] = ()
    statuses: Sequence[str] = ()
    min_duration_ns: int = 0
    max_duration_ns: int = 0

    def conditions(self) -> list[Column]:
        out = self._common("start_ns")
        if self.operations:
            out.append(F.col("operation").isin(*self.operations))
        if self.statuses:
            out.append(F.col("status").isin(*self.statuses))
        if self.min_duration_ns > 0:
            out.append(duration_ns() >= self.min_duration_ns)
        if self.max_duration_ns > 0:
            out.append(duration_ns() <= self.max_duration_ns)
        return out


def matching(df: DataFrame, query: LogQuery | SpanQuery) -> DataFrame:
    """Rows that meet all conditions, of every page; conditions on plain columns reach the scan, and those on time the folders of
    a table stored by day."""
    conditions = query.conditions()
    if "day" in df.columns:
        for bound, compare in ((query.start_ns, Column.__ge__), (query.end_ns, Column.__le__), (Cursor.decode(query.cursor).ts_ns if query.cursor else None, Column.__le__)):
            if bound is not None:
                conditions.append(compare(F.col("day"), F.lit(EPOCH + timedelta(days=bound // DAY_NS))))
    if isinstance(query, LogQuery):
        conditions += query.text_condition("tokens" in df.columns)
    return reduce(DataFrame.filter, conditions, df)


def _page(df: DataFrame, query: LogQuery | SpanQuery, ts: str) -> DataFrame:
    query = query.validate()
    rows = matching(df, query)
    if query.cursor:
        rows = rows.filter(Cursor.decode(query.cursor).before(ts))
    return rows.orderBy(F.desc(ts), F.desc("id")).limit(query.limit)


def search_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One page of logs, newest first, of equal times the greatest id first."""
    return _page(logs, query, "ts_ns")


def search_spans(spans: DataFrame, query: SpanQuery) -> DataFrame:
    """One page of spans, latest start first, of equal starts the greatest id first."""
    return _page(spans, query, "start_ns")


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None
    truncated: bool
    total: int | None


def fetch_page(df: DataFrame, query: LogQuery | SpanQuery, count_total: bool = False) -> Page:
    """A page with the cursor of the next one. A full page is called truncated even if nothing follows it."""
    query = query.validate()
    ts = "ts_ns" if isinstance(query, LogQuery) else "start_ns"
    rows = _page(df, query, ts).collect()
    full = len(rows) == query.limit
    cursor = Cursor(rows[-1][ts], bytes(rows[-1]["id"])).encode() if full else None
    return Page(rows, cursor, full, matching(df, query).count() if count_total else None)


def ndjson(logs: DataFrame) -> DataFrame:
    """One column, line: each log as a flat JSON object of texts, keys sorted; an attribute replaces a field of its name."""
    seconds = F.date_format(utc_seconds(F.col("ts_ns")), "yyyy-MM-dd'T'HH:mm:ss")
    nanos = F.pmod(F.col("ts_ns"), F.lit(1_000_000_000))
    fraction = F.when(nanos == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(nanos.cast("string"), 9, "0"), "0+$", "")))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    fixed = [pair("_time", F.concat(seconds, fraction, F.lit("Z"))), pair("level", F.col("level")), pair("service", F.col("service")), pair("host", F.col("host")), pair("_msg", F.col("body"))]
    ids = [F.when(F.col(c).isNotNull(), F.array(pair(c, F.col(c)))).otherwise(F.array().cast("array<struct<key:string,value:string>>")) for c in ("trace_id", "span_id")]
    every = F.concat(F.array(*fixed), *ids, F.coalesce("attrs", F.array().cast("array<struct<key:string,value:string>>")))
    return logs.select(F.to_json(F.map_from_entries(last_entries(every))).alias("line"))
