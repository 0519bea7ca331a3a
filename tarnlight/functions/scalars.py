"""Scalar functions as Column expressions: levels, ids, labels, durations, scaled values, display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlight.schema import LEVELS


def _div(a: Column, b: int) -> Column:
    """Whole quotient, cut towards zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use() names it; inside a lambda a repeated expression is computed each time."""
    return F.transform(F.array(value), use)[0]


def last_entries(entries: Column) -> Column:
    """Of (key, value) entries with equal keys the last, sorted by key; entries without a key are left out."""
    numbered = F.transform(F.filter(entries, lambda e: e["key"].isNotNull()), lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    last = lambda s: F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["key"] == e["key"], F.lit(False)))
    return F.transform(let(F.sort_array(numbered), last), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def known_level(name: Column) -> Column:
    """The level of a name in all small or all capital letters ("warning" is WARN), null for any other name."""
    pairs = [(s, level) for level in LEVELS for s in (level, level.lower())] + [("WARNING", "WARN"), ("warning", "WARN")]
    out = F.lit(None).cast("string")
    for text, level in pairs:
        out = F.when(name == text, level).otherwise(out)
    return out


def parse_level(name: Column) -> Column:
    """known_level, with INFO for names that aren't one."""
    return F.coalesce(known_level(name), F.lit("INFO"))


def severity_level(text: Column, number: Column) -> Column:
    """Level of an OTLP log: by severity text if that names one, else by the band of the severity number."""
    band = F.when(number >= 21, "FATAL").when(number >= 17, "ERROR").when(number >= 13, "WARN").when(number >= 9, "INFO").when(number >= 5, "DEBUG").when(number >= 1, "TRACE").otherwise("INFO")
    return F.coalesce(known_level(text), band)


def span_status(code: Column) -> Column:
    """Status name of an OTLP status code, given as a number or as its enum name."""
    c = code.cast("string")
    return F.when(c.isin("1", "STATUS_CODE_OK"), "OK").when(c.isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("UNSET")


def new_entry_id(ts_ms: Column) -> Column:
    """A 16-byte id whose order is that of time: 48 bits of milliseconds, 80 random bits."""
    random = F.substring(F.sha2(F.concat(F.uuid()), 256), 1, 20)
    return F.unhex(F.concat(F.lpad(F.hex(ts_ms), 12, "0"), random))


def entry_id_ms(entry_id: Column) -> Column:
    """Milliseconds in an entry id."""
    return F.conv(F.substring(F.hex(entry_id), 1, 12), 16, 10).cast("bigint")


def entry_id_short(entry_id: Column) -> Column:
    """The low 64 bits of an entry id as a hexadecimal text."""
    return F.lower(F.substring(F.hex(entry_id), 17, 16))


def hex_id(value: Column, length: int) -> Column:
    """A hexadecimal id in small letters; null if it isn't `length` digits long or is all zeros."""
    low = F.lower(value)
    return F.when(low.rlike(f"^[0-9a-f]{{{length}}}$") & ~low.rlike("^0+$"), low)


def is_root(parent_id: Column) -> Column:
    return parent_id.isNull()


def duration_ns() -> Column:
    return F.col("end_ns") - F.col("start_ns")


def duration_bucket(ns: Column) -> Column:
    """floor(log2(ns)), 0 below 1 ns; by binary digits, so exact at every power."""
    return F.length(F.bin(F.greatest(ns, F.lit(1).cast("bigint")))) - 1


def duration_buckets(low_ns: int = 0, high_ns: int = 0) -> list[int]:
    """Buckets that hold durations from low_ns to high_ns; 0 leaves a side open."""
    low = max(low_ns, 1).bit_length() - 1 if low_ns > 0 else 0
    high = max(high_ns, 1).bit_length() - 1 if high_ns > 0 else 63
    return list(range(low, high + 1))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def series_key(labels: Column) -> Column:
    """Identity of a series: its labels sorted by name, as "name"="value" parted by commas."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit("="), _quoted(e["value"]))), ",")


def label(labels: Column, name: str) -> Column:
    """A label's value; "" where the series doesn't have it or name is empty."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit("")) if name else F.lit("")


def group_key(labels: Column, names: list[str]) -> Column:
    """Group key of several labels, in the order given, as "name"="value" parted by commas."""
    parts = [F.concat(_quoted(F.lit(n)), F.lit("="), _quoted(label(labels, n))) for n in names]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def otlp_labels(name: Column, resource: Column, scope: Column, point: Column, scale: int | None = None) -> Column:
    """Labels of a data point: resource and scope attributes under a prefix, the point's own, the name and the scale."""
    fixed = [F.lit("__name__"), name] + ([F.lit("__scale__"), F.lit(str(scale))] if scale is not None else [])
    prefix = lambda m, p: F.transform_keys(m, lambda k, _: F.concat(F.lit(p), k))
    prefixed = [prefix(resource, "resource."), prefix(scope, "scope.")]
    merged = F.concat(*(F.map_entries(m) for m in (*prefixed, point, F.create_map(*fixed))))
    # a later entry of a name replaces earlier ones
    return F.map_from_entries(last_entries(merged))


def scaled_value(value: Column, scale: int = 1000) -> Column:
    """round(value * scale), halves away from zero; null for NaN, infinities and what a bigint can't hold."""
    product = value.cast("double") * F.lit(float(scale))
    fits = ~F.isnan(product) & (F.abs(product) < F.lit(9.223372036854775e18))
    return F.when(fits, F.round(product).cast("bigint"))


def nanos_to_millis(ns: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return _div(ns, 1_000_000)


def utc_seconds(ns: Column) -> Column:
    """The UTC time of nanoseconds since 1970, cut to seconds, whatever the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(ns / F.lit(1_000_000_000)))


def average(total: Column, count: Column) -> Column:
    return F.when(count == 0, 0.0).otherwise(total / F.nullif(count, F.lit(0)))


def gamma(scale: int) -> float:
    """Largest relative error of a bucket's midpoint at a scale."""
    base = 2.0 ** (2.0**-scale)
    return (base - 1) / (base + 1)


def exp_bucket(value: Column, scale: int) -> Column:
    """Index of the bucket (2**(i / 2**scale), 2**((i + 1) / 2**scale)] that holds a positive value; exact at the edges."""
    steps = float(2.0**scale)
    i = F.ceil(F.log2(value) * F.lit(steps)) - 1
    low, high = F.pow(F.lit(2.0), i / F.lit(steps)), F.pow(F.lit(2.0), (i + 1) / F.lit(steps))
    return F.when(value <= low, i - 1).when(value > high, i + 1).otherwise(i).cast("int")


def exp_midpoint(index: Column, scale: Column) -> Column:
    """Geometric middle of a bucket."""
    return F.pow(F.lit(2.0), (index + F.lit(0.5)) * F.pow(F.lit(2.0), -scale.cast("double")))


def explicit_bucket(value: Column, bounds: Column) -> Column:
    """Place of the first bound that isn't below the value."""
    return F.size(F.filter(bounds, lambda b: b < value))


def quantile_labels(labels: Column, quantile: Column) -> Column:
    """Labels of one quantile of a summary."""
    return F.map_concat(F.map_filter(labels, lambda k, _: k != "quantile"), F.create_map(F.lit("quantile"), quantile.cast("string")))


def truncated(text: Column, width: int) -> Column:
    """At most width characters, the last of a longer text an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def short_id(value: Column, width: int = 8) -> Column:
    return F.substring(value, 1, width)


def rounded_ms(ns: Column) -> Column:
    """Milliseconds with three digits after the point."""
    return F.round(ns / F.lit(1e6), 3)
