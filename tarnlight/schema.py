"""Schemas of the stored tables, and the fixed sets of names in them."""

from __future__ import annotations

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
STATUSES = ("UNSET", "OK", "ERROR")
METRIC_TYPES = ("gauge", "counter", "histogram", "exponential_histogram")

ATTRS = "array<struct<key:string,value:string>>"
LOGS = f"id binary, ts_ns bigint, ts timestamp, level string, service string, host string, trace_id string, span_id string, body string, attrs {ATTRS}, ingest_seq bigint"
SPANS = f"id binary, trace_id string, span_id string, parent_id string, service string, operation string, start_ns bigint, end_ns bigint, status string, attrs {ATTRS}, ingest_seq bigint"
SAMPLES = "series_key string, labels map<string,string>, type string, ts_ms bigint, value bigint, ingest_seq bigint"
BUCKETS = "struct<offset:int,counts:array<bigint>>"
EXP_HISTOGRAMS = f"series_key string, labels map<string,string>, ts_ms bigint, scale int, zero_threshold double, zero_count bigint, pos {BUCKETS}, neg {BUCKETS}, sum double, count bigint, min double, max double"
EXPLICIT_HISTOGRAMS = "series_key string, labels map<string,string>, ts_ms bigint, bounds array<double>, counts array<bigint>, sum double, count bigint, min double, max double"
