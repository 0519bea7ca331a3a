"""Traces: roll-ups, span trees, correlated logs, look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.operators.search import LogQuery, SpanQuery, matching, search_logs, search_spans
from tarnlight.sources.paths import new_path

TREE_SPANS, TREE_LOGS = 10_000, 100_000


def trace_summaries(spans: DataFrame, query: SpanQuery | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """For each trace of the matching spans: start, end, duration in whole ms, spans, errors, root service and operation.

    The root is the oldest matching span without a parent; where none matches, the newest span of all. Latest start first,
    ties by trace id. Only matching spans count, not the rest of their traces.
    """
    rows = matching(spans, query or SpanQuery())
    parentless = F.col("parent_id").isNull()
    # numbers only, so that the aggregate is by hash; a page then names its own few traces
    out = rows.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("span_count"), F.bool_or(F.col("status") == "ERROR").alias("has_error"),
        F.min(F.when(parentless, F.col("start_ns"))).alias("_root_ns"), F.max("start_ns").alias("_newest_ns"),
    )
    if limit is not None or offset:
        out = out.orderBy(F.desc("start_ns"), "trace_id").offset(offset)
        out = out if limit is None else out.limit(limit)
    chosen = out.select(F.col("trace_id").alias("_trace"), F.coalesce("_root_ns", "_newest_ns").alias("_ns"), F.col("_root_ns").isNotNull().alias("_rooted"))
    # of each trace the spans at the root's time only, mostly one
    named = rows.join(chosen, (F.col("trace_id") == F.col("_trace")) & (F.col("start_ns") == F.col("_ns")) & (parentless | ~F.col("_rooted"))).select("trace_id", "id", "service", "operation", "_rooted")
    oldest = Window.partitionBy("trace_id").orderBy(F.when(F.col("_rooted"), F.col("id")), F.desc("id"))
    named = named.withColumn("_nth", F.row_number().over(oldest)).filter("_nth = 1").select("trace_id", F.col("service").alias("root_service"), F.col("operation").alias("root_operation"))
    out = out.join(named, "trace_id").select("trace_id", "start_ns", "end_ns", F.expr("(end_ns - start_ns) div 1000000").alias("duration_ms"), "span_count", "has_error", "root_service", "root_operation")
    return out if limit is None and not offset else out.orderBy(F.desc("start_ns"), "trace_id")


def trace_total(spans: DataFrame, query: SpanQuery | None = None) -> DataFrame:
    """(total): how many traces have a matching span, for all pages of trace_summaries()."""
    return matching(spans, query or SpanQuery()).agg(F.count_distinct("trace_id").alias("total"))


def unique_spans(spans: DataFrame) -> DataFrame:
    """Of spans that share trace and span id only the last one, by ingest_seq, ties by id."""
    newest = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("ingest_seq"), F.desc("id"))
    return spans.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


#: Bytes of paths and rows that a task sends at once.
BATCH_BYTES = 16_000_000
#: More spans than these, and a trace is not one task's work.
LARGE_TRACE = 250_000
_COUNTERS = 1 << 16
_EDGE = ["trace_id", "span_id", "parent_id", "service", "operation", "start_ns", "end_ns", "status"]


def trace_edges(spans: DataFrame) -> DataFrame:
    """Each span with its parent's service and operation, is_root (no parent, or one that isn't there), and its offset from the trace's start.

    Traces are brought together in one shuffle; those that may have more than LARGE_TRACE spans, if any, are joined by span
    instead, so that such a trace is many tasks' work.
    """
    small, large = _by_size(spans)
    edges = _edges_together(small)
    return edges if large is None else edges.unionByName(_edges_joined(large))


def _by_size(spans: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The spans of small traces and, if there are any, those of traces that may be large.

    Only trace ids are read for it, and spans counted by a hash of them, so the driver gets at most one number for each LARGE_TRACE spans.
    """
    counter = F.pmod(F.xxhash64("trace_id"), F.lit(_COUNTERS))
    full = [r.c for r in spans.groupBy(counter.alias("c")).count().filter(F.col("count") > LARGE_TRACE).select("c").collect()]
    if len(full) > _COUNTERS // 4:  # by sheer number of traces: these are counted one by one
        ids = spans.groupBy("trace_id").count().filter(F.col("count") > LARGE_TRACE).select("trace_id")
        same = F.col("trace_id").eqNullSafe(F.col("_large"))
        ids = ids.withColumnRenamed("trace_id", "_large")
        return spans.join(ids, same, "left_anti"), spans.join(ids, same, "left_semi")
    if not full:
        return spans, None
    flagged = counter.isin(full)
    return spans.filter(~flagged), spans.filter(flagged)


def _edges_together(spans: DataFrame) -> DataFrame:
    """trace_edges() in one shuffle, by trace. Rows of a trace lie in a row in one partition."""
    rows = spans.select(*_EDGE, "id", "ingest_seq").repartition("trace_id")
    newest = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("ingest_seq"), F.desc("id"))
    own = rows.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "id", "ingest_seq")
    own = own.withColumn("_first", F.min("start_ns").over(Window.partitionBy("trace_id")))
    # each span once under its own id and once under its parent's, where it comes after that one
    places = F.array(F.struct(F.col("span_id").alias("key"), F.lit(False).alias("below")), F.struct(F.col("parent_id").alias("key"), F.lit(True).alias("below")))
    both = own.select("*", F.explode(places).alias("_at")).select("*", "_at.key", "_at.below").drop("_at")
    # the places of parents need no more than their names
    both = both.select("trace_id", "key", "below", "service", "operation", *[F.when(F.col("below"), F.col(c)).alias(c) for c in ("span_id", "start_ns", "end_ns", "status", "_first")])
    upper = Window.partitionBy("trace_id", "key").orderBy("below").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("trace_id").isNotNull() & F.col("key").isNotNull()
    both = both.withColumn("_up", F.first(F.when(~F.col("below") & known, F.struct("service", "operation"))).over(upper)).filter("below")
    return both.select(
        "trace_id", "span_id", F.col("key").alias("parent_id"), "service", "operation", "start_ns", "end_ns", "status", F.col("_up.service").alias("parent_service"), F.col("_up.operation").alias("parent_operation"),
        F.col("_up").isNull().alias("is_root"), (F.col("start_ns") - F.col("_first")).alias("offset_ns"),
    )


def _edges_joined(spans: DataFrame) -> DataFrame:
    """trace_edges() by joins whose shuffles are by span; the spans are read once, those left of repeated ones are written to the shared folder."""
    own, _ = _stored(unique_spans(spans.select(*_EDGE, "id", "ingest_seq")).drop("id", "ingest_seq"), "spans")
    parents = own.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("parent_service"), F.col("operation").alias("parent_operation"), F.lit(True).alias("_found"))
    starts = own.groupBy(F.col("trace_id").alias("_trace")).agg(F.min("start_ns").alias("_first"))
    return (
        own.join(parents, ["trace_id", "parent_id"], "left")
        .join(starts, F.col("trace_id").eqNullSafe(F.col("_trace")))
        .select(*_EDGE, "parent_service", "parent_operation", F.col("_found").isNull().alias("is_root"), (F.col("start_ns") - F.col("_first")).alias("offset_ns"))
    )


def trace_tree(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """trace_edges() with depth (0 for roots) and path (the span ids from the root down, parted by "/").

    Spans of a cycle, which no root leads to, are left out; max_depth, if given, cuts off what is deeper. Paths are written
    where a trace's spans lie together, so they cross no shuffle; those of traces too large for one task are joined.
    """
    small, large = _by_size(spans)
    edges = _edges_together(small)
    # the sort is the edges' own and not repeated
    out = edges.sortWithinPartitions("trace_id").mapInArrow(_with_paths, edges.withColumn("depth", F.lit(0)).withColumn("path", F.col("span_id")).schema)
    if large is not None:
        out = out.unionByName(_tree_joined(_edges_joined(large)))
    return out if max_depth is None else out.filter(F.col("depth") <= max_depth)


def _with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with depth and path, from batches in which the rows of each trace follow one another; the trace at the end of one waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("trace_id")
        if waiting and ids[0] != waiting[0].column("trace_id")[-1]:
            yield from _paths(waiting)
            waiting = []
        cut = batch.num_rows - 1
        last = ids[cut]
        while cut and ids[cut - 1] == last:
            cut -= 1
        if cut:
            yield from _paths([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from _paths(waiting)


def _paths(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole traces with depth and path, roots before what is under them, in batches of bounded size."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    traces, ids, parents, root = (rows[c].to_pylist() for c in ("trace_id", "span_id", "parent_id", "is_root"))
    under: dict[tuple[str, str], list[int]] = {}
    for i, top in enumerate(root):
        if not top:
            under.setdefault((traces[i], parents[i]), []).append(i)
    at: list[int] = []
    depths: list[int] = []
    paths: list[str | None] = []
    size = 0
    for i, top in enumerate(root):
        if not top:
            continue
        open_, line = [(i, 0)], []
        while open_:
            k, depth = open_.pop()
            del line[depth:]
            line.append(ids[k])
            path = ids[k] if not depth else "/".join(line)
            at.append(k)
            depths.append(depth)
            paths.append(path)
            size += len(path or "") + 100
            if size > BATCH_BYTES:
                yield _taken(rows, at, depths, paths)
                at, depths, paths, size = [], [], [], 0
            below = under.get((traces[k], ids[k]))
            if below:
                open_.extend([(x, depth + 1) for x in below])
    if at:
        yield _taken(rows, at, depths, paths)


def _taken(rows: pa.Table, at: list[int], depths: list[int], paths: list[str | None]) -> pa.RecordBatch:
    out = rows.take(pa.array(at, pa.int64())).append_column("depth", pa.array(depths, pa.int32())).append_column("path", pa.array(paths, pa.string()))
    return out.combine_chunks().to_batches()[0]


def _tree_joined(edges: DataFrame) -> DataFrame:
    """trace_tree() by joins. Each span looks up the span its path begins under, which then begins under that one's: as paths
    double in length each time, a chain of n spans takes log2(n) joins. Each round is written to the shared folder, so that
    lost executors cost no rerun of others.
    """
    spark = edges.sparkSession
    begun = edges.withColumn("depth", F.lit(0)).withColumn("path", F.col("span_id")).withColumn("_up", F.when(~F.col("is_root"), F.col("parent_id")))
    now, _ = _stored(begun, "tree")
    done, open_ = [_stored(now.filter("_up IS NULL"), "paths")[1]], _stored(now.filter("_up IS NOT NULL"), "open")[0]
    while True:
        above = spark.read.schema(now.schema).parquet(*done).unionByName(open_).select("trace_id", F.col("span_id").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("_up").alias("_next"))
        longer = open_.join(above, ["trace_id", "_up"]).withColumn("path", F.concat("_path", F.lit("/"), "path")).withColumn("depth", F.col("depth") + F.col("_depth") + 1).withColumn("_up", F.col("_next")).select(*now.columns)
        round_, _ = _stored(longer, "tree")
        ended, path = _stored(round_.filter("_up IS NULL"), "paths")
        if ended.isEmpty():  # all that is left hangs in cycles
            break
        done.append(path)
        open_ = round_.filter("_up IS NOT NULL")
    return spark.read.schema(now.schema).parquet(*done).drop("_up")


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def logs_of_spans(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Each span of trace_edges() with its logs, oldest first, and log_count; logs of no span of their trace are not among them."""
    mine = logs.filter("span_id IS NOT NULL").groupBy("trace_id", "span_id").agg(F.array_sort(F.collect_list(F.struct("ts_ns", "id", "level", "body"))).alias("logs"))
    joined = trace_edges(spans).join(mine, ["trace_id", "span_id"], "left")
    return joined.withColumn("logs", F.coalesce("logs", F.array().cast(mine.schema["logs"].dataType))).withColumn("log_count", F.size("logs"))


def lookup_trace(spans: DataFrame, logs: DataFrame, trace_id: str, span_limit: int = TREE_SPANS, log_limit: int = TREE_LOGS) -> tuple[DataFrame, DataFrame]:
    """The newest spans and the newest logs of one trace, each up to its own limit."""
    return search_spans(spans, SpanQuery(trace_id=trace_id, limit=span_limit)), search_logs(logs, LogQuery(trace_id=trace_id, limit=log_limit))
