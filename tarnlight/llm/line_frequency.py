"""Operator 8, quality rules: lines that many documents of a host share, and documents with little else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import content_key, free_name, quoted, read, written

#: A line goes where more than MIN_DOCS documents and more than MAX_SHARE of a host's documents have it.
MIN_DOCS, MAX_SHARE = 10, 0.01
#: A document goes where fewer than this share of its non-blank characters is left.
MIN_KEPT = 0.3
#: With more frequent lines than this, over all hosts, each document's own are joined to it by a shuffle.
BROADCAST_LINES = 500_000


def normalised(line: F.Column) -> F.Column:
    """Lower case, each run of white space one space, none at the ends."""
    # a single space needs no replacement, so it is none
    return F.trim(F.regexp_replace(F.lower(line), "(?: [ \\t\\r\\f\\x0B]|[\\t\\r\\f\\x0B])[ \\t\\r\\f\\x0B]*+", " "))


def _hashes(text: F.Column) -> F.Column:
    """A hash of each line, normalised."""
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(normalised(x)))


def clean_lines(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """docs without lines that are frequent on their host and without depleted documents; other columns as they were.

    Documents are counted by content: byte-identical texts of one host are one document. A null host is a host of its own.
    Blank lines are never counted and stay. A text with no word of its own left (null, empty, blank) is depleted. Repeated
    rows all stay or all go. Lines end at a newline only. A text may be of any length. An n_chars column, if there is one,
    follows the text. Other columns may have any names.
    """
    h, bad, bad_key = (free_name(docs, c) for c in ("kept_text", "bad_lines", "bad_key"))
    texts = docs.select(quoted(host).alias("host"), quoted(text).alias("text"), content_key(host, text).alias("key"))
    blank = F.xxhash64(F.lit(""))
    exploded = texts.filter(F.length(F.trim("text")) > 0).select("host", "key", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("h")).filter(F.col("h") != blank)
    # one row for each line of each distinct document; key and line are hashes, so no text is shuffled
    pairs = exploded.dropDuplicates(["host", "key", "h"])
    counts = pairs.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    sizes = texts.groupBy("host").agg(F.count_distinct("key").alias("docs"))
    frequent = counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))).filter(F.col("n") > F.col("docs") * F.lit(max_share))
    # a host has fewer frequent lines than its documents have lines on average / max_share, however many documents
    frequent = written(frequent.select(F.col("c.host").alias("host"), "h"), "frequent_lines")
    if frequent.count() <= broadcast_lines:
        lists = F.broadcast(frequent.groupBy(F.col("host").alias(bad_key)).agg(F.collect_list("h").alias(bad)))
        joined = docs.join(lists, quoted(host).eqNullSafe(F.col(bad_key)), "left")
    else:
        # each document's own frequent lines come back to it by its content: no host is gathered anywhere
        own = pairs.alias("p").join(frequent.alias("f"), F.col("p.host").eqNullSafe(F.col("f.host")) & (F.col("p.h") == F.col("f.h"))).groupBy(F.col("p.key").alias(bad_key)).agg(F.collect_list("p.h").alias(bad))
        joined = docs.join(own, content_key(host, text) == F.col(bad_key), "left")
    each = F.arrays_zip(F.split(quoted(text), "\n").alias("line"), _hashes(quoted(text)).alias("h"))
    kept = F.transform(F.filter(each, lambda z: ~F.array_contains(F.col(bad), z["h"])), lambda z: z["line"])
    size = lambda c: F.length(F.regexp_replace(c, "\\s+", ""))
    out = joined.withColumn(h, F.when(F.col(bad).isNull(), quoted(text)).otherwise(F.array_join(kept, "\n")))
    whole = F.length(F.col(h)) == F.length(quoted(text))
    out = out.filter(F.col(h).rlike("\\S") & (F.col(bad).isNull() | F.when(whole, True).otherwise(size(F.col(h)) >= size(quoted(text)) * F.lit(min_kept))))
    new = {c: F.col(h).alias(c) if c == text else F.length(F.col(h)).cast("long").alias(c) if c == "n_chars" and text == "text" else quoted(c) for c in docs.columns}
    return out.select(*new.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents),
lines AS (
  SELECT rid, source, text, ord, line, trim(regexp_replace(lower(line), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM docs)),
sizes AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_docs FROM docs GROUP BY source),
bad AS (
  SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines WHERE norm <> '' GROUP BY ALL) l
  JOIN sizes s ON l.source IS NOT DISTINCT FROM s.source WHERE n > {MIN_DOCS} AND n > n_docs * {MAX_SHARE}::DOUBLE),
flagged AS (SELECT l.*, b.norm IS NOT NULL AS is_bad FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm),
kept AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT is_bad), '') AS new_text, bool_or(is_bad) AS touched FROM flagged GROUP BY rid),
sized AS (
  SELECT d.*, new_text, touched, length(regexp_replace(new_text, '\\s+', '', 'g')) AS left_over, length(regexp_replace(text, '\\s+', '', 'g')) AS before
  FROM docs d JOIN kept USING (rid))
SELECT doc_id, new_text AS text, lang, source, length(new_text)::BIGINT AS n_chars
FROM sized WHERE left_over > 0 AND (NOT touched OR left_over >= before * {MIN_KEPT}::DOUBLE)
"""
