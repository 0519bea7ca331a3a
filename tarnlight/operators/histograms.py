"""Histogram queries: merging, quantiles and summaries of exponential and explicit histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.scalars import exp_midpoint, group_key, label
from tarnlight.operators.selectors import Selector


def within(ticks: DataFrame, selector: Selector, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Ticks of the matching series in the closed time range; every tick counts, later ones don't replace earlier ones."""
    out = selector.apply(ticks)
    if start_ms is not None:
        out = out.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        out = out.filter(F.col("ts_ms") <= end_ms)
    return out


def _group(by: str | list[str]) -> Column:
    return label(F.col("labels"), by) if isinstance(by, str) else group_key(F.col("labels"), by)


def exp_buckets(ticks: DataFrame, by: str | list[str] = "") -> DataFrame:
    """(grp, scale, sign, index, n): the merged buckets of each group at its coarsest scale; sign 0 holds the zero counts.

    A bucket i of a finer scale lies in bucket i >> difference of the coarser one.
    """
    # an array's place is its offset plus its position; nulls come from empty arrays
    parts = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("pos.offset").alias("offset"), F.col("pos.counts").alias("counts")),
        F.struct(F.lit(-1).alias("sign"), F.col("neg.offset").alias("offset"), F.col("neg.counts").alias("counts")),
        F.struct(F.lit(0).alias("sign"), F.lit(0).alias("offset"), F.array("zero_count").alias("counts")),
    )
    flat = ticks.select(_group(by).alias("grp"), "scale", F.explode(parts).alias("p")).select("grp", "scale", "p.sign", "p.offset", F.posexplode("p.counts").alias("i", "n"))
    # one row for each bucket of each scale first, so that the coarsest scale is joined to few rows
    each = flat.groupBy("grp", "scale", "sign", (F.col("offset") + F.col("i")).alias("index")).agg(F.sum("n").alias("n"))
    coarsest = F.min("scale").over(Window.partitionBy("grp"))
    shifted = each.withColumn("_to", coarsest).select("grp", F.col("_to").alias("scale"), "sign", F.expr("if(sign = 0, 0, shiftright(index, scale - _to))").alias("index"), "n")
    return shifted.groupBy("grp", "scale", "sign", "index").agg(F.sum("n").alias("n")).filter("n > 0")


def exp_merge(ticks: DataFrame, by: str | list[str] = "") -> DataFrame:
    """One exponential histogram for each group: (grp, scale, zero_count, pos, neg as maps of index to count, sum, count, min, max)."""
    b = exp_buckets(ticks, by)
    of = lambda sign: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("sign") == sign, F.struct("index", "n"))), lambda x: x.isNotNull())))
    merged = b.groupBy("grp", "scale").agg(F.sum(F.when(F.col("sign") == 0, F.col("n")).otherwise(0)).alias("zero_count"), of(1).alias("pos"), of(-1).alias("neg"))
    return merged.join(summary(ticks, by), "grp")


def _first_reaching(rows: DataFrame, q: float, order: Column, value: Column) -> DataFrame:
    """Of each group the value of the first row at which the running count reaches q of the total."""
    q = min(max(q, 0.0), 1.0)
    w = Window.partitionBy("grp").orderBy(order)
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy("grp"))
    ranked = rows.select("grp", order.alias("_order"), value.alias("_value"), cum.alias("_cum"), total.alias("_total"))
    return ranked.filter(F.col("_cum") >= F.lit(q) * F.col("_total")).groupBy("grp").agg(F.min_by("_value", "_order").alias("value"))


def exp_quantile(ticks: DataFrame, q: float, by: str | list[str] = "") -> DataFrame:
    """(grp, value): the geometric middle of the bucket that holds rank q, from the most negative bucket up; groups without values have no row."""
    value = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * exp_midpoint(F.col("index"), F.col("scale")))
    return _first_reaching(exp_buckets(ticks, by), q, F.col("sign") * F.when(F.col("sign") == 0, 0).otherwise(F.lit(1 << 40) + F.col("index")), value)


def explicit_merge(ticks: DataFrame, by: str | list[str] = "") -> DataFrame:
    """(grp, bounds, i, n, lo, hi): bucket counts of each group; merging different bounds is an error."""
    flat = ticks.select(_group(by).alias("grp"), "bounds", "min", "max", F.posexplode("counts").alias("i", "n"))
    out = flat.groupBy("grp", "i").agg(F.sum("n").alias("n"), F.min("bounds").alias("bounds"), F.max("bounds").alias("_other"), F.min("min").alias("lo"), F.max("max").alias("hi"))
    checked = F.when(F.col("bounds") == F.col("_other"), F.col("bounds")).otherwise(F.raise_error(F.lit("histograms with different bounds can't be merged")).cast("array<double>"))
    return out.withColumn("bounds", checked).drop("_other")


def explicit_quantile(ticks: DataFrame, q: float, by: str | list[str] = "") -> DataFrame:
    """(grp, value): rank q interpolated within its bucket; the outermost buckets end at the least and the greatest value seen."""
    q = min(max(q, 0.0), 1.0)
    m = explicit_merge(ticks, by)
    every = Window.partitionBy("grp")
    cum = F.sum("n").over(every.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = m.withColumn("cum", cum).withColumn("rank", F.lit(q) * F.sum("n").over(every)).withColumn("lo", F.min("lo").over(every)).withColumn("hi", F.max("hi").over(every))
    first = rows.filter("cum >= rank AND cum > 0").groupBy("grp").agg(F.min_by(F.struct("i", "n", "bounds", "lo", "hi", "cum", "rank"), "i").alias("b")).select("grp", "b.*")
    bound = lambda i: F.try_element_at("bounds", i.cast("int"))
    low = F.coalesce(F.when(F.col("i") > 0, bound(F.greatest(F.col("i"), F.lit(1)))), F.col("lo"), bound(F.col("i") + 1))
    high = F.coalesce(bound(F.col("i") + 1), F.col("hi"), bound(F.greatest(F.col("i"), F.lit(1))))
    share = F.when(F.col("n") > 0, (F.col("rank") - (F.col("cum") - F.col("n"))) / F.col("n")).otherwise(0.0)
    return first.select("grp", (low + (high - low) * share).alias("value"))


def summary(ticks: DataFrame, by: str | list[str] = "") -> DataFrame:
    """(grp, sum, count, min, max) over ticks of either kind."""
    return ticks.groupBy(_group(by).alias("grp")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def summary_of_both(exp: DataFrame, explicit: DataFrame, by: str | list[str] = "") -> DataFrame:
    columns = ["labels", "sum", "count", "min", "max"]
    return summary(exp.select(columns).unionByName(explicit.select(columns)), by)


def synopses(ticks: DataFrame) -> DataFrame:
    """What is known of each series without its buckets: ticks, values, sum, range and times."""
    return ticks.groupBy("series_key").agg(F.count("*").alias("ticks"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))
