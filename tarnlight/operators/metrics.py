"""Metric queries: select, sum, aggregate, increase and rate, over one window or at each step of a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.scalars import average, label
from tarnlight.operators.selectors import NAME, Selector

MAX_STEPS = 10_000


@dataclass(frozen=True)
class Options:
    """Bounds on samples: a closed time range in ms, a closed value range, the widest gap between samples of a series.

    Value bounds hold before differences are taken. A gap wider than max_gap_ms inside a window leaves the series out of it.
    """

    start_ms: int | None = None
    end_ms: int | None = None
    min_value: int | None = None
    max_value: int | None = None
    max_gap_ms: int | None = None

    def validate(self) -> Options:
        if self.start_ms is not None and self.end_ms is not None and self.start_ms > self.end_ms:
            raise ValueError("the time range ends before it starts")
        if self.max_gap_ms is not None and self.max_gap_ms <= 0:
            raise ValueError("max_gap_ms must be positive")
        return self

    def apply(self, samples: DataFrame) -> DataFrame:
        for bound, condition in ((self.start_ms, F.col("ts_ms") >= F.lit(self.start_ms)), (self.end_ms, F.col("ts_ms") <= F.lit(self.end_ms)), (self.min_value, F.col("value") >= F.lit(self.min_value)), (self.max_value, F.col("value") <= F.lit(self.max_value))):
            if bound is not None:
                samples = samples.filter(condition)
        return samples


def window_options(end_ms: int, window_ms: int, **more) -> Options:
    """The closed window of window_ms up to end_ms."""
    return Options(end_ms - window_ms, end_ms, **more)


@dataclass(frozen=True)
class Steps:
    """The grid start, start + step, ... up to end; each step looks back over the closed window [t - window, t]."""

    start_ms: int
    end_ms: int
    step_ms: int
    window_ms: int

    def validate(self) -> Steps:
        if self.step_ms < 1:
            raise ValueError("step must be at least 1 ms")
        if self.window_ms < 1:
            raise ValueError("window must be at least 1 ms")
        if self.end_ms < self.start_ms:
            raise ValueError("end must be at or after start")
        if self.last >= MAX_STEPS:
            raise ValueError(f"more than {MAX_STEPS} steps")
        return self

    @property
    def last(self) -> int:
        return (self.end_ms - self.start_ms) // self.step_ms

    def reach(self, options: Options) -> Options:
        return Options(self.start_ms - self.window_ms, self.start_ms + self.last * self.step_ms, options.min_value, options.max_value, options.max_gap_ms).validate()

    def first_at(self, ts: Column) -> Column:
        """Number of the first step at or after a time."""
        return F.floor((ts - F.lit(self.start_ms - self.step_ms + 1)) / F.lit(self.step_ms)).cast("bigint")

    def last_at(self, ts: Column) -> Column:
        """Number of the last step at or before a time."""
        return F.floor((ts - F.lit(self.start_ms)) / F.lit(self.step_ms)).cast("bigint")

    def at(self, first: Column, last: Column) -> Column:
        """The numbers of the steps from first to last that the grid has."""
        a, b = F.greatest(first, F.lit(0).cast("bigint")), F.least(last, F.lit(self.last).cast("bigint"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    def grid(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.range(self.last + 1).select((F.lit(self.start_ms) + F.col("id") * self.step_ms).alias("step_ms"))


def select(samples: DataFrame, selector: Selector, options: Options = Options()) -> DataFrame:
    """Samples of the matching series within the bounds."""
    return options.validate().apply(selector.apply(samples))


def select_stored(samples: DataFrame, series: DataFrame, selector: Selector, options: Options = Options()) -> DataFrame:
    """select() on tables stored by metric name: labels are looked up in the table of series, once for each series, and its keys
    choose the samples. Name and bounds reach the scan of samples, their labels aren't read."""
    names = Selector(tuple(m for m in selector.validate().matchers if m.name == NAME))
    found = options.validate().apply(names.apply(samples))
    chosen = selector.apply(series).select("metric_name", "series_key", "labels")
    return found.drop("labels").join(chosen, ["metric_name", "series_key"])


def latest_writes(samples: DataFrame) -> DataFrame:
    """Of the samples that share series and time only the last written, the greatest of equal writes; one shuffle by series, which later windows reuse."""
    w = Window.partitionBy("series_key").orderBy("ts_ms", "ingest_seq", "value")
    following = F.lead("ts_ms").over(w)
    return samples.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") != F.col("ts_ms"))).drop("_next")


def aggregate_by_label(samples: DataFrame, selector: Selector, by: str, options: Options = Options()) -> DataFrame:
    """(grp, sum, count, min, max, avg) of the samples of each value of a label; samples of equal times all count."""
    rows = select(samples, selector, options)
    out = rows.groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("value").alias("sum"), F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.withColumn("avg", average(F.col("sum"), F.col("count")))


def sum_by_label(samples: DataFrame, selector: Selector, by: str, options: Options = Options()) -> DataFrame:
    """(grp, value): sums of samples."""
    return select(samples, selector, options).groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("value").alias("value"))


def _with_previous(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy("ts_ms")
    return latest_writes(samples).withColumn("prev_ts", F.lag("ts_ms").over(w)).withColumn("prev_value", F.lag("value").over(w))


def _summaries(rows: DataFrame, keys: list[str], inside: Column, max_gap_ms: int | None) -> DataFrame:
    """First and last sample, increase, resets and count; inside says whether the previous sample is in the same window.

    A fall of the counter adds nothing and counts as a reset. Summaries with fewer than two samples or no time between
    them, or with too wide a gap, are left out.
    """
    delta = F.col("value") - F.col("prev_value")
    out = rows.groupBy(*keys).agg(
        F.first("labels").alias("labels"),
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        F.min_by("value", "ts_ms").alias("first_value"),
        F.max_by("value", "ts_ms").alias("last_value"),
        F.sum(F.when(inside & (delta > 0), delta).otherwise(0)).alias("increase"),
        F.sum(F.when(inside & (delta < 0), 1).otherwise(0)).alias("resets"),
        F.count("*").alias("samples"),
        F.max(F.when(inside, F.col("ts_ms") - F.col("prev_ts"))).alias("_gap"),
    )
    out = out.filter((F.col("samples") >= 2) & (F.col("last_ts") > F.col("first_ts")))
    if max_gap_ms is not None:
        out = out.filter(F.coalesce(F.col("_gap"), F.lit(0)) <= max_gap_ms)
    return out.drop("_gap")


def _rate() -> Column:
    return F.col("increase") / ((F.col("last_ts") - F.col("first_ts")) / F.lit(1000.0))


def rate_summaries(samples: DataFrame, selector: Selector, options: Options = Options()) -> DataFrame:
    """For each matching series: first and last sample, increase, resets, samples and rate a second."""
    rows = _with_previous(select(samples, selector, options))
    return _summaries(rows, ["series_key"], F.col("prev_ts").isNotNull(), options.max_gap_ms).withColumn("rate", _rate())


def rate_by_label(samples: DataFrame, selector: Selector, by: str, options: Options = Options()) -> DataFrame:
    """(grp, value): sums of the series' rates a second."""
    return rate_summaries(samples, selector, options).groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("rate").alias("value"))


def increase_by_label(samples: DataFrame, selector: Selector, by: str, options: Options = Options()) -> DataFrame:
    """(grp, value): sums of the series' increases."""
    return rate_summaries(samples, selector, options).groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("increase").alias("value"))


def merge_rate_summaries(parts: DataFrame) -> DataFrame:
    """Summaries of the same series over periods that don't overlap as one: what the counter gained between two periods counts too."""
    w = Window.partitionBy("series_key").orderBy("first_ts")
    delta = F.col("first_value") - F.lag("last_value").over(w)
    rows = parts.withColumn("_up", F.when(delta > 0, delta).otherwise(0)).withColumn("_reset", F.when(delta < 0, 1).otherwise(0))
    return rows.groupBy("series_key").agg(
        F.first("labels").alias("labels"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min_by("first_value", "first_ts").alias("first_value"), F.max_by("last_value", "last_ts").alias("last_value"),
        (F.sum("increase") + F.sum("_up")).alias("increase"), (F.sum("resets") + F.sum("_reset")).alias("resets"), F.sum("samples").alias("samples"),
    ).withColumn("rate", _rate())


def _windows(rows: DataFrame, steps: Steps, max_gap_ms: int | None, sums: bool) -> DataFrame:
    """For each series and step with samples in its window, from rows of _with_previous: series_key, labels, step_ms, samples,
    first_ts, last_ts, and sum, min and max of the values, if sums, or else increase and resets.

    Each sample says at which steps it is the first of the window and at which the last; a step's two samples then give its
    window by differences of running totals. Times are cut into blocks as long as a window, so that a window lies in two:
    its least value is that of the block's rest from the first sample on, or of the block's part up to the last one. So the
    rows grow with samples + series x steps, however many samples a window holds, in one shuffle by series.
    """
    order = Window.partitionBy("series_key").orderBy("ts_ms")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    length = steps.window_ms + 1
    block = lambda ts: F.floor(ts / F.lit(length)).cast("bigint")
    part = Window.partitionBy("series_key", "_block").orderBy("ts_ms")
    # what follows a sample is what precedes it from the other end: a frame with an open end is computed anew for each row
    back = Window.partitionBy("series_key", "_block").orderBy(F.desc("ts_ms"))
    upto, onward, later = part.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    delta = F.col("value") - F.col("prev_value")
    rows = rows.withColumn("_block", block(F.col("ts_ms"))).withColumn("_next", F.lead("ts_ms").over(order)).withColumn("_gap", F.col("ts_ms") - F.col("prev_ts"))
    state = {"ts": F.col("ts_ms"), "block": F.col("_block"), "n": F.row_number().over(order)}
    if sums:
        state |= {"own": F.col("value"), "total": F.sum("value").over(past), "low_upto": F.min("value").over(upto), "low_onward": F.min("value").over(onward), "high_upto": F.max("value").over(upto), "high_onward": F.max("value").over(onward)}
    else:
        state |= {"up": F.sum(F.when(delta > 0, delta).otherwise(0)).over(past), "falls": F.sum(F.when(delta < 0, 1).otherwise(0)).over(past)}
    if max_gap_ms is not None:
        inner = F.when(F.lag("ts_ms").over(part).isNotNull(), F.col("_gap"))
        state |= {"gap_upto": F.max("_gap").over(upto), "gap_inner": F.max(inner).over(upto), "gap_later": F.max("_gap").over(later)}
    for name, c in state.items():
        rows = rows.withColumn(f"_s_{name}", c)
    here = F.struct(*[F.col(f"_s_{name}").alias(name) for name in state])
    reach = steps.last_at(F.col("ts_ms") + steps.window_ms)
    begin = steps.first_at(F.col("ts_ms"))
    lasts = steps.at(begin, F.least(reach, F.coalesce(steps.first_at(F.col("_next")) - 1, reach)))
    firsts = steps.at(F.greatest(begin, F.coalesce(steps.last_at(F.col("prev_ts") + steps.window_ms) + 1, begin)), reach)
    event = lambda side: lambda k: F.struct(k.alias("k"), F.lit(side).alias("first"))
    each = rows.select("series_key", "labels", here.alias("here"), F.explode(F.concat(F.transform(firsts, event(True)), F.transform(lasts, event(False)))).alias("e"))
    both = each.groupBy("series_key", F.col("e.k").alias("k")).agg(F.first("labels").alias("labels"), F.first(F.when(F.col("e.first"), F.col("here")), ignorenulls=True).alias("f"), F.first(F.when(~F.col("e.first"), F.col("here")), ignorenulls=True).alias("l"))
    step = F.lit(steps.start_ms) + F.col("k") * F.lit(steps.step_ms)
    begins = F.col("f.block") == block(step - steps.window_ms)
    ends = F.col("l.block") != block(step - steps.window_ms)
    out = {"step_ms": step, "samples": (F.col("l.n") - F.col("f.n") + 1).cast("bigint"), "first_ts": F.col("f.ts"), "last_ts": F.col("l.ts")}
    if sums:
        out |= {"sum": F.col("l.total") - F.col("f.total") + F.col("f.own")}
        out |= {name: f(F.when(begins, F.col(f"f.{side}_onward")), F.when(ends, F.col(f"l.{side}_upto"))) for name, side, f in (("min", "low", F.least), ("max", "high", F.greatest))}
    else:
        out |= {"increase": F.col("l.up") - F.col("f.up"), "resets": F.col("l.falls") - F.col("f.falls")}
    if max_gap_ms is not None:
        gap = F.greatest(F.when(begins, F.col("f.gap_later")), F.when(ends, F.when(begins, F.col("l.gap_upto")).otherwise(F.col("l.gap_inner"))))
        both = both.filter(F.coalesce(gap, F.lit(0)) <= max_gap_ms)
    return both.select("series_key", "labels", *[c.alias(name) for name, c in out.items()])


def _on_grid(found: DataFrame, steps: Steps, with_empty: bool) -> DataFrame:
    return steps.grid(found).join(found, "step_ms", "left") if with_empty else found


def aggregate_steps(samples: DataFrame, selector: Selector, by: str, steps: Steps, options: Options = Options(), with_empty: bool = False) -> DataFrame:
    """(step_ms, grp, sum, count, min, max, avg) over each step's window; of equal times the last write counts.

    with_empty adds a row of nulls for each step without samples.
    """
    rows = _windows(_with_previous(select(samples, selector, steps.validate().reach(options))), steps, options.max_gap_ms, sums=True)
    out = rows.groupBy("step_ms", label(F.col("labels"), by).alias("grp")).agg(F.sum("sum").alias("sum"), F.sum("samples").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))
    return _on_grid(out.withColumn("avg", average(F.col("sum"), F.col("count"))), steps, with_empty)


def sum_steps(samples: DataFrame, selector: Selector, by: str, steps: Steps, options: Options = Options(), with_empty: bool = False) -> DataFrame:
    return aggregate_steps(samples, selector, by, steps, options, with_empty).select("step_ms", "grp", F.col("sum").alias("value"))


def _summary_steps(samples: DataFrame, selector: Selector, steps: Steps, options: Options) -> DataFrame:
    rows = _with_previous(select(samples, selector, steps.validate().reach(options)))
    return _windows(rows, steps, options.max_gap_ms, sums=False).filter((F.col("samples") >= 2) & (F.col("last_ts") > F.col("first_ts")))


def rate_steps(samples: DataFrame, selector: Selector, by: str, steps: Steps, options: Options = Options(), with_empty: bool = False) -> DataFrame:
    """(step_ms, grp, value): sums of the series' rates a second over each step's window."""
    rows = _summary_steps(samples, selector, steps, options).withColumn("rate", _rate())
    return _on_grid(rows.groupBy("step_ms", label(F.col("labels"), by).alias("grp")).agg(F.sum("rate").alias("value")), steps, with_empty)


def increase_steps(samples: DataFrame, selector: Selector, by: str, steps: Steps, options: Options = Options(), with_empty: bool = False) -> DataFrame:
    """(step_ms, grp, value): sums of the series' increases over each step's window."""
    rows = _summary_steps(samples, selector, steps, options)
    return _on_grid(rows.groupBy("step_ms", label(F.col("labels"), by).alias("grp")).agg(F.sum("increase").alias("value")), steps, with_empty)


def zone_maps(samples: DataFrame) -> DataFrame:
    """For each series: min, max, sum, count, first and last value, whether it never falls, whether it has a reset (counters only)."""
    rows = samples.withColumn("prev", F.lag("value").over(Window.partitionBy("series_key").orderBy("ts_ms", "ingest_seq")))
    order = F.struct("ts_ms", "ingest_seq")
    out = rows.groupBy("series_key").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("*").alias("count"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"),
        F.bool_and(F.coalesce(F.col("value") >= F.col("prev"), F.lit(True))).alias("_rises"), F.first("type").alias("type"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"),
    )
    counter = F.col("type") == "counter"
    return out.withColumn("monotonic", counter & F.col("_rises")).withColumn("has_reset", counter & ~F.col("_rises")).drop("_rises", "type")


def aggregate_buckets(samples: DataFrame, size: int = 64) -> DataFrame:
    """Sum, count, min and max of each `size` samples in a row of a series."""
    w = Window.partitionBy("series_key").orderBy("ts_ms", "ingest_seq")
    rows = samples.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy("series_key", "bucket").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.sum("value").alias("sum"), F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))


def aggregate_zones(zones: DataFrame, series: DataFrame, selector: Selector, by: str) -> DataFrame:
    """aggregate_by_label() without bounds from zone_maps() alone: one row a series, no sample is read."""
    rows = selector.apply(series).select("series_key", "labels").join(zones, "series_key")
    out = rows.groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.withColumn("avg", average(F.col("sum"), F.col("count")))


def rollup(samples: DataFrame, every_ms: int = 3_600_000) -> DataFrame:
    """Sum, count, min and max of each series in each whole span of every_ms (span_ms is its start)."""
    span = (F.floor(F.col("ts_ms") / F.lit(every_ms)) * every_ms).cast("bigint").alias("span_ms")
    return samples.groupBy("series_key", span).agg(F.first("labels").alias("labels"), F.sum("value").alias("sum"), F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))


def aggregate_rolled(samples: DataFrame, rolled: DataFrame, selector: Selector, by: str, start_ms: int, end_ms: int, every_ms: int = 3_600_000) -> DataFrame:
    """aggregate_by_label() from start to end: the whole spans between from rollup(), the samples of the two ends as they are."""
    first, last = -(-start_ms // every_ms) * every_ms, (end_ms + 1) // every_ms * every_ms
    inner = selector.apply(rolled).filter((F.col("span_ms") >= first) & (F.col("span_ms") < last)).select("labels", "sum", "count", "min", "max")
    ends = select(samples, selector, Options(start_ms, end_ms))
    if first < last:
        ends = ends.filter((F.col("ts_ms") < first) | (F.col("ts_ms") >= last))
    one = ends.select("labels", F.col("value").alias("sum"), F.lit(1).cast("bigint").alias("count"), F.col("value").alias("min"), F.col("value").alias("max"))
    rows = inner.union(one) if first < last else one
    out = rows.groupBy(label(F.col("labels"), by).alias("grp")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.withColumn("avg", average(F.col("sum"), F.col("count")))
