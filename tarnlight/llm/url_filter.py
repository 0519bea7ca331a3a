"""Operator 3, URL filters: block lists as sorted arrays of 64-bit digests, memory-mapped by the tasks that probe them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import free_name, quoted, read
from tarnlight.sources.paths import new_path

#: A host is listed whole with at least this many labelled pages of which at least this share is toxic.
HOST_PAGES, HOST_SHARE = 5, 0.8
HOST = "^([^/?#]*)"


def normalised(url: Column) -> Column:
    """host[:port]/path?query of a URL, without scheme, user, fragment, "www.", default port and closing slash; host and all in lower case."""
    u = F.lower(F.trim(url))
    for pattern in ("#.*$", "^[a-z][a-z0-9+.-]*://", "^[^/?@]*@", "^www\\."):
        u = F.regexp_replace(u, pattern, "")
    u = F.regexp_replace(u, "^([^/?:]*):(?:80|443)([/?]|$)", "$1$2")
    return F.regexp_replace(u, "/+$", "")


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for any other file system."""
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def _put(uri: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def _map(uri: str) -> pa.Buffer:
    """The file's bytes: a memory map where the folder is mounted, else read once."""
    path = local_path(uri)
    if path is not None:
        return pa.memory_map(path, "rb").read_buffer()
    fs, inner = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(inner) as f:
        return f.read_buffer()


class DigestIndex:
    """Parts of a block list in order of their digests; only (path, first, last) of each part is held, files open on first use."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = sorted(parts, key=lambda p: p[1])
        self.open: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return {"parts": self.parts, "open": {}}

    def _part(self, i: int) -> tuple:
        if i not in self.open:
            path = self.parts[i][0]
            keys = np.frombuffer(_map(path + ".keys"), np.int64)
            with pa.ipc.open_file(_map(path + ".entries")) as f:
                self.open[i] = keys, f.read_all().column("entry").combine_chunks()
        return self.open[i]

    def probe(self, keys: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether each text is an entry: binary search by digest, then the stored string; every entry of an equal digest is compared."""
        found = np.zeros(len(keys), bool)
        if not self.parts or not len(keys):
            return found
        firsts = np.array([p[1] for p in self.parts])
        lasts = np.array([p[2] for p in self.parts])
        at = np.searchsorted(firsts, keys, "right") - 1
        at[(at >= 0) & (keys > lasts[np.maximum(at, 0)])] = -1
        for i in np.unique(at[at >= 0]):
            stored, entries = self._part(i)
            rows = np.flatnonzero(at == i)
            low, high = np.searchsorted(stored, keys[rows], "left"), np.searchsorted(stored, keys[rows], "right")
            rows, low, high = rows[low < high], low[low < high], high[low < high]
            while len(rows):
                same = pc.equal(entries.take(pa.array(low)), texts.take(pa.array(rows)).cast(entries.type)).to_numpy(zero_copy_only=False)
                found[rows[same]] = True
                more = ~same & (low + 1 < high)
                rows, low, high = rows[more], low[more] + 1, high[more]
        return found


def build_index(entries: DataFrame, column: str = "entry") -> DigestIndex:
    """Write a block list (one string column; null and empty entries are left out, repeated ones kept once) as a digest index in the shared folder.

    Entries are sorted by digest across all tasks; each task writes one part under a name of its own, so a repeated task
    leaves an unused file and no damage. The driver receives one row for each part.
    """
    folder = new_path(entries.sparkSession, "digests")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:
            t = pa.concat_tables(tables)
            path = f"{folder}/{uuid.uuid4().hex}"
            keys = t["key"].to_numpy()
            _put(path + ".keys", np.ascontiguousarray(keys, np.int64).tobytes())
            out = pa.BufferOutputStream()
            one = t.select(["entry"]).cast(pa.schema([("entry", pa.large_string())])).combine_chunks()
            with pa.ipc.new_file(out, one.schema) as w:
                w.write_table(one)
            _put(path + ".entries", out.getvalue())
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [int(keys[0])], "last": [int(keys[-1])]})

    rows = entries.select(quoted(column).cast("string").alias("entry")).filter("entry <> ''").distinct().select(F.xxhash64("entry").alias("key"), "entry")
    parts = rows.repartitionByRange("key").sortWithinPartitions("key", "entry").mapInArrow(write, "path string, first long, last long").collect()
    return DigestIndex([tuple(p) for p in parts])


def filter_urls(pages: DataFrame, index: DigestIndex, url: str = "url") -> DataFrame:
    """All rows and columns of pages with blocked_by: the list entry that matches, or null.

    A page is blocked by its whole normalised URL, its URL without the query, its host, or a parent domain of its host (of two
    labels at least), the first of these that is listed. A null or empty URL is never blocked. Repeated rows are judged alike.
    """
    name = free_name(pages, "blocked_by")
    u = normalised(quoted(url))
    host = F.regexp_replace(F.regexp_extract(u, HOST, 1), ":[0-9]*$", "")
    labels = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    candidates = F.filter(F.concat(F.array(u, F.regexp_replace(u, "\\?.*$", "")), domains), lambda x: x != "")
    cand, digest = free_name(pages, "url_candidates"), free_name(pages, "url_digests")
    ready = pages.withColumn(cand, F.coalesce(candidates, F.array().cast("array<string>"))).withColumn(digest, F.transform(quoted(cand), lambda x: F.xxhash64(x)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = b.column(cand_at), b.column(digest_at)
            parents = pc.list_parent_indices(texts).to_numpy()
            flat = texts.flatten()
            hit = index.probe(keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat)
            where = np.flatnonzero(hit)
            rows, first = np.unique(parents[where], return_index=True)
            take = np.full(b.num_rows, -1)
            take[rows] = where[first]
            matched = flat.take(pa.array(take, mask=take < 0)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), matched], names=out_names)

    cand_at, digest_at = len(pages.columns), len(pages.columns) + 1
    keep, out_names = range(len(pages.columns)), [*pages.columns, name]
    schema = type(pages.schema)(list(pages.schema.fields)).add(name, "string")
    return ready.mapInArrow(probe, schema)


def labelled_list(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The block list of the query: URLs of pages labelled toxic, and hosts of mostly toxic pages.

    Pages or labels without an id are left out; a page that is repeated, or labelled twice, counts each time for its host; a
    null URL is in no list. build_index() keeps an entry once. Other columns aren't looked at.
    """
    known = pages.join(labels, pages.page_id == labels.doc_id).select(normalised(F.col("url")).alias("u"), "toxic").withColumn("host", F.regexp_replace(F.regexp_extract("u", HOST, 1), ":[0-9]*$", ""))
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter((F.col("n") >= HOST_PAGES) & (F.col("bad") >= F.col("n") * HOST_SHARE))
    return known.filter("toxic = 1").select(F.col("u").alias("entry")).union(hosts.select("host"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), build_index(labelled_list(pages, read(spark, sf_dir, "labels"))))


_U = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?@]*@', ''), '^www\\.', ''), '^([^/?:]*):(?:80|443)([/?]|$)', '\\1\\2'), '/+$', '')"
SQL = f"""
WITH urls AS (SELECT page_id, url, {_U} AS u FROM pages),
hosted AS (SELECT *, regexp_replace(regexp_extract(u, '{HOST}', 1), ':[0-9]*$', '') AS host FROM urls),
known AS (SELECT u, host, toxic FROM hosted JOIN labels ON page_id = doc_id),
list AS (
  SELECT u AS entry FROM known WHERE toxic = 1 AND u <> ''
  UNION SELECT host FROM known WHERE host <> '' GROUP BY host HAVING count(*) >= {HOST_PAGES} AND sum(toxic) >= count(*) * {HOST_SHARE}),
candidates AS (
  SELECT page_id, url, 1 AS ord, u AS c FROM hosted
  UNION ALL SELECT page_id, url, 2, regexp_replace(u, '\\?.*$', '') FROM hosted
  UNION ALL SELECT page_id, url, 2 + i, array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM hosted)),
hit AS (SELECT page_id, url, arg_min(entry, ord) AS blocked_by FROM candidates JOIN list ON c = entry GROUP BY ALL)
SELECT p.page_id, p.url, h.blocked_by FROM pages p LEFT JOIN hit h ON p.page_id = h.page_id AND p.url = h.url
"""
