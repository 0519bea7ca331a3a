"""OTLP requests in protobuf as the JSON texts that otlp.py reads: the wire format of the public opentelemetry-proto messages."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: For each message its fields by number: name in JSON, kind, whether it is repeated. A kind is a message or a scalar.
_KV = {1: ("key", "text", False), 2: ("value", "AnyValue", False)}
_POINT = {2: ("startTimeUnixNano", "fixed64", False), 3: ("timeUnixNano", "fixed64", False)}
MESSAGES: dict[str, dict[int, tuple[str, str, bool]]] = {
    "KeyValue": _KV,
    "AnyValue": {1: ("stringValue", "text", False), 2: ("boolValue", "bool", False), 3: ("intValue", "int64", False), 4: ("doubleValue", "double", False), 5: ("arrayValue", "ArrayValue", False), 6: ("kvlistValue", "KeyValueList", False), 7: ("bytesValue", "base64", False)},
    "ArrayValue": {1: ("values", "AnyValue", True)},
    "KeyValueList": {1: ("values", "KeyValue", True)},
    "Attributed": {1: ("attributes", "KeyValue", True)},
    "Scope": {3: ("attributes", "KeyValue", True)},
    "logs": {1: ("resourceLogs", "ResourceLogs", True)},
    "ResourceLogs": {1: ("resource", "Attributed", False), 2: ("scopeLogs", "ScopeLogs", True)},
    "ScopeLogs": {2: ("logRecords", "LogRecord", True)},
    "LogRecord": {1: ("timeUnixNano", "fixed64", False), 2: ("severityNumber", "int", False), 3: ("severityText", "text", False), 5: ("body", "AnyValue", False), 6: ("attributes", "KeyValue", True), 9: ("traceId", "hex", False), 10: ("spanId", "hex", False)},
    "spans": {1: ("resourceSpans", "ResourceSpans", True)},
    "ResourceSpans": {1: ("resource", "Attributed", False), 2: ("scopeSpans", "ScopeSpans", True)},
    "ScopeSpans": {2: ("spans", "Span", True)},
    "Span": {
        1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 4: ("parentSpanId", "hex", False), 5: ("name", "text", False), 7: ("startTimeUnixNano", "fixed64", False), 8: ("endTimeUnixNano", "fixed64", False),
        9: ("attributes", "KeyValue", True), 15: ("status", "Status", False),
    },
    "Status": {3: ("code", "int64", False)},
    "metrics": {1: ("resourceMetrics", "ResourceMetrics", True)},
    "ResourceMetrics": {1: ("resource", "Attributed", False), 2: ("scopeMetrics", "ScopeMetrics", True)},
    "ScopeMetrics": {1: ("scope", "Scope", False), 2: ("metrics", "Metric", True)},
    "Metric": {1: ("name", "text", False), 5: ("gauge", "Gauge", False), 7: ("sum", "Sum", False), 9: ("histogram", "Histogram", False), 10: ("exponentialHistogram", "ExponentialHistogram", False), 11: ("summary", "Summary", False)},
    "Gauge": {1: ("dataPoints", "NumberPoint", True)},
    "Sum": {1: ("dataPoints", "NumberPoint", True), 2: ("aggregationTemporality", "int64", False), 3: ("isMonotonic", "bool", False)},
    "Histogram": {1: ("dataPoints", "HistogramPoint", True), 2: ("aggregationTemporality", "int64", False)},
    "ExponentialHistogram": {1: ("dataPoints", "ExpPoint", True), 2: ("aggregationTemporality", "int64", False)},
    "Summary": {1: ("dataPoints", "SummaryPoint", True)},
    "NumberPoint": _POINT | {4: ("asDouble", "double", False), 6: ("asInt", "sfixed64", False), 7: ("attributes", "KeyValue", True)},
    "HistogramPoint": _POINT | {
        4: ("count", "fixed64", False), 5: ("sum", "double", False), 6: ("bucketCounts", "fixed64", True), 7: ("explicitBounds", "double", True), 9: ("attributes", "KeyValue", True), 11: ("min", "double", False), 12: ("max", "double", False),
    },
    "ExpPoint": _POINT | {
        1: ("attributes", "KeyValue", True), 4: ("count", "fixed64", False), 5: ("sum", "double", False), 6: ("scale", "sint", False), 7: ("zeroCount", "fixed64", False), 8: ("positive", "Buckets", False), 9: ("negative", "Buckets", False),
        12: ("min", "double", False), 13: ("max", "double", False), 14: ("zeroThreshold", "double", False),
    },
    "Buckets": {1: ("offset", "sint", False), 2: ("bucketCounts", "int64", True)},
    "SummaryPoint": _POINT | {4: ("count", "fixed64", False), 5: ("sum", "double", False), 6: ("quantileValues", "Quantile", True), 7: ("attributes", "KeyValue", True)},
    "Quantile": {1: ("quantile", "double", False), 2: ("value", "double", False)},
}
KINDS = ("logs", "spans", "metrics")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return out, at
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def _number(kind: str, raw: int):
    if kind == "bool":
        return bool(raw)
    if kind == "sint":
        return (raw >> 1) ^ -(raw & 1)
    signed = raw - (1 << 64) if raw >= 1 << 63 else raw
    return signed if kind == "int" else str(signed)


def _fixed(kind: str, data: bytes):
    if kind == "double":
        value = struct.unpack("<d", data)[0]
        return value if value - value == 0 else "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    return str(struct.unpack("<q" if kind == "sfixed64" else "<Q", data)[0])


def _bytes(kind: str, data: bytes):
    if kind == "text":
        return data.decode()
    if kind == "hex":
        return data.hex()
    if kind == "base64":
        import base64

        return base64.b64encode(data).decode()
    return decode(data, kind)


def decode(data: bytes, message: str) -> dict:
    """A message as its JSON object; unknown fields are passed over, numbers of 64 bits are texts. ValueError where it can't be read."""
    out: dict = {}
    at, fields = 0, MESSAGES[message]
    try:
        while at < len(data):
            tag, at = _varint(data, at)
            name, kind, repeated = fields.get(tag >> 3, ("", "", False))
            wire = tag & 7
            if wire == 0:
                raw, at = _varint(data, at)
                values = [_number(kind, raw)] if name else []
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                raw, at = data[at : at + size], at + size
                values = [_fixed(kind, raw)] if name else []
            elif wire == 2:
                size, at = _varint(data, at)
                if at + size > len(data):
                    raise ValueError("cut off")
                raw, at = data[at : at + size], at + size
                if not name:
                    values = []
                elif kind in ("double", "fixed64", "sfixed64"):  # packed
                    values = [_fixed(kind, raw[i : i + 8]) for i in range(0, size, 8)]
                elif kind in ("int64", "int", "sint", "bool"):
                    values, i = [], 0
                    while i < size:
                        n, i = _varint(raw, i)
                        values.append(_number(kind, n))
                else:
                    values = [_bytes(kind, raw)]
            else:
                raise ValueError(f"wire type {wire}")
            for v in values:
                if repeated:
                    out.setdefault(name, []).append(v)
                else:
                    out[name] = v
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"can't be read as {message}") from e
    return out


def to_json(requests: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """(json) for each request body (binary) of one kind, "logs", "spans" or "metrics"; null for one that can't be read, which otlp.py then rejects.

    Works on tables and streams, on Arrow batches: each body is read in one pass.
    """
    if kind not in KINDS:
        raise ValueError(f"not one of {KINDS}: {kind!r}")

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else json.dumps(decode(data, kind))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"json": pa.array([one(x.as_py()) for x in b.column(0)], pa.string())})

    return requests.select(body).mapInArrow(run, "json string")
