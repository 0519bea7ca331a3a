"""Operator 1, WARC: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import read

CRAWL_DATE = "2024-01-01T00:00:00Z"
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
#: The rest of a tag: a ">" inside quotes doesn't end it. What has more quoted values than a tag ever has ends at the first ">".
_REST = r"""(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*){0,100}>|[^>]*>)"""
#: Pattern and replacement, one after the other; each is valid, with the same meaning, for Java and for RE2.
TO_TEXT = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<script\b.*?(?:</script\s*>|\z)", ""),
    (r"(?is)<style\b.*?(?:</style\s*>|\z)", ""),
    (rf"(?i)</?(?:{BLOCKS})\b{_REST}", "\n"),
    (rf"</?[a-zA-Z!?]{_REST}", ""),
]
#: After the entities are decoded.
TO_LINES = [
    (r"[ \t\r\f\x0B]+", " "),
    (r" ?\n[ \n]*", "\n"),
]
LINK = r"""(?i)<a\b(?:[^>"']*(?:"[^"]*"|'[^']*')){0,100}?[^>"']*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TITLE = r"(?is)<title[^>]*>(.*?)</title"
ENTITY = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});"
#: What a named entity stands for. Numbers of control characters mean those of windows-1252; a no-break space is a space.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " ", "#160": " "}
ENTITIES |= {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


def decoded(text: Column) -> Column:
    """text with its entities decoded, each once: named ones of HTML 4, and numbers, decimal or hexadecimal, of any character. A
    number that is no character's gives U+FFFD; what isn't an entity stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        hexed = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 9)).otherwise(F.hex(F.substring(name, 2, 9).try_cast("bigint")))
        code = F.conv(hexed, 16, 10).cast("bigint")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")).otherwise("\ufffd")
        meant = F.coalesce(F.try_element_at(names, name), F.when(F.startswith(name, F.lit("#")), char))
        return F.when(i == 0, part).when(meant.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(meant, F.substr(part, F.length(name) + 2)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """Visible text of a page: no comments, scripts, styles or tags; block tags end lines; entities are decoded."""
    for pattern, new in TO_TEXT:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(new))
    html = decoded(html)
    for pattern, new in TO_LINES:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(new))
    return F.btrim(html, F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def responses(pages: DataFrame, crawl_date: str = CRAWL_DATE) -> DataFrame:
    """WARC response records of crawled pages (page_id, url, html); other columns are not carried.

    A null url or html counts as empty. Rows equal in all three give equal records, with equal identifiers.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(crawl_date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n")).alias("http_headers"),
        F.concat(F.lit("sha256:"), F.sha2(html, 256)).alias("payload_digest"),
        html.alias("payload"),
    )


def derive(records: DataFrame) -> DataFrame:
    """For each response record one metadata and one conversion record, both with WARC-Refers-To its identifier.

    Both keep the response's target URI, date, HTTP headers (source_headers) and payload digest (source_digest); content_length
    and block_digest are those of the new record's own block. An empty page gives an empty conversion record, which stays linked.
    Metadata blocks are application/warc-fields: title (line breaks as spaces), source digest, and each link in its order, quoted
    in either way or not at all. Equal records give equal records; payloads may be null, which is empty, and of any length;
    other columns are not carried, whatever their names.
    """
    records = records.withColumn("payload", F.coalesce("payload", F.lit("")))
    title = F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "[ \\t\\r\\n\\f\\x0B]+", " ")
    link = lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "^[\"']|[\"']$|[\\r\\n]", ""), F.lit(" L a/@href\r\n"))
    links = F.array_join(F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), link), "")
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nsource-digest: "), F.col("payload_digest"), F.lit("\r\n"), links)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("content")),
    )
    each = records.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", F.explode(kinds).alias("new"))
    return each.select(
        "page_id",
        "new.warc_type",
        _urn(F.col("new.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        "new.content_type",
        F.octet_length("new.content").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("new.content", 256)).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        F.col("http_headers").alias("source_headers"),
        "new.content",
    )


def record_bytes(derived: DataFrame) -> DataFrame:
    """derived with the column record: each record as it stands in a WARC/1.1 file."""
    head = [
        ("WARC-Type", F.col("warc_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To-Date", F.col("warc_date")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("WARC-Source-Payload-Digest", F.col("source_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.col("content_length").cast("string")),
    ]
    lines = [x for name, value in head for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return derived.withColumn("record", F.encode(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("content"), F.lit("\r\n\r\n")), "utf-8"))


_CHARSET = re.compile(rb"(?im)^content-type:[^\r\n]*charset=[\"']?([\w.:-]+)")


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by small letters, block) of each record of an uncompressed WARC stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def _body(headers: bytes, data: bytes) -> bytes:
    """The payload without its transfer and content encodings, as far as they can be undone."""
    low = headers.lower()
    if b"transfer-encoding: chunked" in low:
        out, rest = b"", data
        while (size := rest.partition(b"\r\n")[0].split(b";")[0].strip()) and re.fullmatch(rb"[0-9a-fA-F]+", size) and int(size, 16):
            at = rest.index(b"\r\n") + 2
            out, rest = out + rest[at : at + int(size, 16)], rest[at + int(size, 16) + 2 :]
        data = out or data
    try:
        if re.search(rb"content-encoding:\s*(x-)?gzip", low):
            return gzip.decompress(data)
        if re.search(rb"content-encoding:\s*deflate", low):
            return zlib.decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    return data


def read_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The response records of WARC files, compressed by record or not, with the columns of responses(); page_id is null.

    Headers, dates, identifiers and digests are those of the file; a missing payload digest is made. Each file is one task's
    work, read as a stream, so that no more than a record is held. Records of other types and blocks that aren't HTTP are left
    out. The text is decoded by the charset of the header, UTF-8 if there is none, bad bytes as U+FFFD.
    """
    schema = "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload_digest string, payload string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
                raw = fs.open_input_stream(path, compression=None)
                stream = io.BufferedReader(raw)
                if stream.peek(2)[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                for head, block in _records(stream):
                    headers, mark, data = block.partition(b"\r\n\r\n")
                    if head.get("warc-type") != "response" or not mark or not block.startswith(b"HTTP/"):
                        continue
                    data = _body(headers, data)
                    charset = _CHARSET.search(headers)
                    try:
                        text = data.decode(charset[1].decode() if charset else "utf-8", "replace")
                    except LookupError:
                        text = data.decode("utf-8", "replace")
                    digest = head.get("warc-payload-digest") or "sha256:" + hashlib.sha256(data).hexdigest()
                    row = (None, head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri", "").strip("<>"), head.get("warc-date", ""), headers.decode("latin-1") + "\r\n", digest, text)
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.string()) for i, v in enumerate(row)], names=names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(read(spark, sf_dir, "pages")))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'" if "\n" not in value else "chr(10)"


def _sql_replaced(html: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        html = f"regexp_replace({html}, {_sql_text(pattern)}, {_sql_text(new)}, 'g')"
    return html


_SQL_NAME = f"regexp_extract(p, '{ENTITY}', 1)"
_SQL_CODE = f"CASE WHEN {_SQL_NAME} LIKE '#x%' OR {_SQL_NAME} LIKE '#X%' THEN ('0x' || substr({_SQL_NAME}, 3))::BIGINT WHEN {_SQL_NAME} LIKE '#%' THEN substr({_SQL_NAME}, 2)::BIGINT END"
_SQL_CHAR = f"CASE WHEN {_SQL_CODE} BETWEEN 1 AND 1114111 AND NOT {_SQL_CODE} BETWEEN 55296 AND 57343 THEN chr(({_SQL_CODE})::INTEGER) WHEN {_SQL_CODE} IS NOT NULL THEN chr(65533) END"
_SQL_MEANT = f"coalesce(map_extract(m, {_SQL_NAME})[1], {_SQL_CHAR})"
_SQL_DECODED = f"array_to_string(list_transform(string_split(stripped, '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {_SQL_MEANT} IS NULL THEN '&' || p ELSE {_SQL_MEANT} || substr(p, length({_SQL_NAME}) + 2) END), '')"


_CRLF = "chr(13) || chr(10)"
_SQL_UUID = "'urn:uuid:' || regexp_replace({}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
SQL = f"""
WITH entities AS (SELECT map([{", ".join(_sql_text(k) for k in ENTITIES)}], [{", ".join(_sql_text(v) for v in ENTITIES.values())}]) AS m),
pages_ AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
responses AS (
  SELECT page_id, {_SQL_UUID.format("md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|' || md5(html))")} AS refers_to, url AS target_uri, '{CRAWL_DATE}' AS warc_date,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || octet_length(encode(html)) || {_CRLF} AS source_headers,
    'sha256:' || sha256(html) AS source_digest, html FROM pages_),
texts AS (SELECT *, {_SQL_DECODED} AS plain FROM (SELECT *, {_sql_replaced("html", TO_TEXT)} AS stripped FROM responses), entities),
each_ AS (
  SELECT refers_to, page_id, target_uri, warc_date, source_headers, source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || regexp_replace(regexp_extract(html, '{TITLE}', 1), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g') || {_CRLF} || 'source-digest: ' || source_digest || {_CRLF}
    || coalesce(list_aggregate(list_transform(regexp_extract_all(html, {_sql_text(LINK)}, 1), lambda x: 'outlink: ' || regexp_replace(x, '^["'']|["'']$|[\\r\\n]', '', 'g') || ' L a/@href' || {_CRLF}), 'string_agg', ''), '') AS content
  FROM responses
  UNION ALL SELECT refers_to, page_id, target_uri, warc_date, source_headers, source_digest, 'conversion', 'text/plain; charset=utf-8', trim({_sql_replaced("plain", TO_LINES)}, ' ' || chr(10)) FROM texts)
SELECT page_id, warc_type, {_SQL_UUID.format("md5(warc_type || '|' || refers_to)")} AS record_id, refers_to, target_uri, warc_date, content_type,
  octet_length(encode(content))::BIGINT AS content_length, 'sha256:' || sha256(content) AS block_digest, source_digest, source_headers, content FROM each_
"""
