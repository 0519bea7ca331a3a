"""Operator 7, substring dedup: repeated token k-mers as edges of a de Bruijn graph, compacted into long repeated spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tarnlight.llm.common import quoted, read, written
from tarnlight.llm.textnp import WORD_BASE, inverse, mix, ngrams, powers, whole, words

#: Words in a k-mer, and so in the shortest span that is found.
K = 50
#: Words in the shorter k-mers of which the least chooses a k-mer's bucket.
ANCHOR = 25
#: Rows of the buckets that are counted together; a bucket is never cut.
BUCKET_ROWS = 30_000
#: A sieve of contents has 2**SIEVE places, 64 in a word.
SIEVE = 20
NO_ID = np.iinfo(np.int64).max
NAMES = ["m", "c", "times", "first_id", "tokens", "node", "side", "edge"]
SCHEMA = "m long, c long, times int, first_id long, tokens binary, node long, side byte, edge long"
SECOND = np.uint64(0x5851F42D4C957F2D)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n values in a row, by doubling."""
    done, out = 1, x
    while done * 2 <= n:
        out = f(out[: len(out) - done], out[done:])
        done *= 2
    rest = n - done
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(h: np.ndarray, at: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of successive k-mers of a row that share their least anchor-mer, the leftmost of equal ones, as do the nodes between them.

    For each run: first k-mer, number of k-mers, anchor, hash of all its words, anchors of its first and its last node. Equal
    k-mers have equal anchors, equal nodes too.
    """
    n = len(h)
    if n < k:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64))
    inside = whole(at, k, n)
    x = ngrams(h, anchor)
    least, node = _sliding(x, k - anchor + 1, np.minimum), _sliding(x, k - anchor, np.minimum)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    parted = (least[1:] != least[:-1]) | (x[: len(least) - 1] == least[:-1]) | (node[1 : len(least)] != least[1:]) | (row[1:] != row[:-1])
    start = np.flatnonzero(inside & np.r_[True, parted | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[parted | ~inside[1:], True])
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h + SECOND) * powers(WORD_BASE, n), out=prefix[1:])
    content = mix((prefix[last + k] - prefix[start]) * powers(inverse(WORD_BASE), n)[start] + (last - start).astype(np.uint64))
    return start, last - start + 1, least[start], content, node[start], node[last + 1]


def _ids(column: pa.Array) -> np.ndarray:
    """Ids with the greatest number for null, so that it is never the least of several."""
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False)


def _once(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows, in sorted order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


FOUND = "m long, c long, a int, b int, parts array<long>, piece long, head long, tail long, edges long, first_id long"


def _found(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of FOUND, the columns that aren't given null."""
    kinds = {"m": pa.int64(), "c": pa.int64(), "a": pa.int32(), "b": pa.int32(), "parts": pa.list_(pa.int64()), "piece": pa.int64(), "head": pa.int64(), "tail": pa.int64(), "edges": pa.int64(), "first_id": pa.int64()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def chains(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u -> after[u] (-1 for none), at most one into each: the first of each one's chain, and its place in it.

    Of a closed chain the least one is the first. Links double in length each round.
    """
    n = len(after)
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    least, up = np.arange(n), before.copy()
    for _ in range(int(n).bit_length()):
        on = up >= 0
        least[on] = np.minimum(least[on], least[up[on]])
        up[on] = up[up[on]]
    before[(up >= 0) & (least == np.arange(n))] = -1  # a closed chain is opened at its least
    first, place = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    for _ in range(int(n).bit_length()):
        place, first = place + place[first], first[first]
    return first, place


def count_edges(batch: pa.Table, k: int) -> list[pa.RecordBatch]:
    """For whole buckets of super-k-mers: the runs of repeated edges in each, the branching nodes, and the pieces of nonbranching
    paths that lie in one bucket: each repeated edge of the bucket is in one piece, named by its first edge.

    Rows with tokens are super-k-mers, of which every edge counts `times`; rows without are edges from other buckets that
    touch a node of this one. All edges of a node meet in the node's bucket, and all places of an edge in each of its buckets.
    """
    guest = batch.filter(pc.is_null(batch["tokens"]))
    own = batch.filter(pc.is_valid(batch["tokens"])).combine_chunks()
    v, side, g = (guest[c].to_numpy() for c in ("node", "side", "edge"))
    _, which = np.unique(g, return_inverse=True)
    often = np.bincount(which, weights=guest["times"].to_numpy(), minlength=1)[which] >= 2 if len(g) else np.zeros(0, bool)
    v, side, g = v[often], side[often], g[often]
    out = []
    if own.num_rows:
        tokens = own["tokens"].chunk(0)
        sizes = pc.binary_length(tokens).to_numpy() // 4
        at = np.concatenate([[0], np.cumsum(sizes)])
        words32 = np.frombuffer(b"".join(tokens.to_pylist()), np.uint32).astype(np.uint64)
        ok = np.flatnonzero(whole(at, k, len(words32)))
        holder = np.searchsorted(at, ok, "right") - 1
        edge, node = ngrams(words32, k).view(np.int64), ngrams(words32, k - 1).view(np.int64)
        kinds, which = np.unique(edge[ok], return_inverse=True)
        often = np.bincount(which, weights=own["times"].to_numpy()[holder])[which] >= 2
        first = np.full(len(kinds), NO_ID)
        np.minimum.at(first, which, _ids(own["first_id"].combine_chunks())[holder])
        left, right, e = node[ok][often], node[ok + 1][often], edge[ok][often]
        v, side, g = np.concatenate([v, left, right]), np.concatenate([side, np.ones(len(e), np.int8), np.zeros(len(e), np.int8)]), np.concatenate([g, e, e])
    one = _once(v, side, g)
    v, side = v[one], side[one]
    branching = np.unique(v[1:][(v[1:] == v[:-1]) & (side[1:] == side[:-1])])
    if own.num_rows and often.any():
        place, h = ok[often], holder[often]
        new = np.r_[True, (np.diff(place) > 1) | (np.diff(h) > 0)]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(place)] - 1
        cut = np.isin(node[place], branching) & ~new
        used, at_used, mine = np.unique(which[often], return_index=True, return_inverse=True)
        after = np.full(len(used), -1)
        linked = np.flatnonzero(~new[1:] & ~np.isin(node[place[1:]], branching))
        after[mine[linked]] = mine[linked + 1]
        first_edge, step = chains(after)
        name = kinds[used][first_edge]
        size = np.bincount(first_edge, minlength=len(used))
        ends = np.flatnonzero(step == size[first_edge] - 1)
        begins = first_edge[ends]
        out.append(_found(piece=pa.array(kinds[used][begins]), head=pa.array(node[place[at_used[begins]]]), tail=pa.array(node[place[at_used[ends]] + 1]), edges=pa.array(size[begins].astype(np.int64))))
        part = np.flatnonzero(new | cut)
        offsets = np.r_[np.searchsorted(part, start), len(part)].astype(np.int32)
        c = own.take(pa.array(h[start]))
        ids = first[which[often][start]]
        out.append(
            _found(
                m=c["m"].combine_chunks(), c=c["c"].combine_chunks(), a=pa.array((place[start] - at[h[start]]).astype(np.int32)), b=pa.array((place[end] - at[h[start]]).astype(np.int32)),
                parts=pa.ListArray.from_arrays(pa.array(offsets), pa.array(name[mine[part]])), head=pa.array(node[place[start]], mask=place[start] > at[h[start]]), first_id=pa.array(ids, mask=ids == NO_ID),
            )
        )
    if len(branching):
        out.append(_found(head=pa.array(branching)))
    return out


def compact(pieces: DataFrame, branching: DataFrame) -> DataFrame:
    """(piece, path): the nonbranching path that each piece (piece, head, tail, edges) is part of, named by the path's first piece.

    A piece goes on in the one that begins with the node it ends with, unless that node branches: one join. Then each piece looks
    up the piece it hangs under, and after that the one that hangs under, so that the longest path takes as many joins as the
    logarithm of its pieces. A closed path, which has no first piece, stays in pieces.
    """
    inner = pieces.select("piece", F.col("tail").alias("node")).join(branching.select(F.col("head").alias("node")), "node", "left_anti")
    follows = inner.join(pieces.select(F.col("head").alias("node"), F.col("piece").alias("next")), "node").select(F.col("next").alias("piece"), F.col("piece").alias("up")).filter("piece <> up")
    now = written(pieces.select("piece").distinct().join(follows.groupBy("piece").agg(F.min("up").alias("up")), "piece", "left").select("piece", F.coalesce("up", "piece").alias("path"), "up"), "pieces")
    done, open_ = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
    while True:
        above = done.union(open_).select(F.col("piece").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_next"))
        now = written(open_.join(above, "up").select("piece", F.col("_path").alias("path"), F.col("_next").alias("up")), "pieces")
        ended = now.filter("up IS NULL")
        if ended.isEmpty():
            return done.select("piece", "path").union(now.select("piece", F.col("piece").alias("path")))
        done, open_ = done.union(ended), now.filter("up IS NOT NULL")


def sieve(contents: DataFrame) -> np.ndarray:
    """Words of 64 bits with the bit of each content's first SIEVE bits set. The executors join them, so that the driver gets a
    row a word at most, however many contents there are."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(c, {64 - SIEVE}) & 63L AS int))")
    rows = contents.groupBy(F.shiftrightunsigned("c", 70 - SIEVE).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words64 = np.zeros(1 << (SIEVE - 6), np.int64)
    words64[[r.word for r in rows]] = [r.bits for r in rows]
    return words64


def repeated_spans(docs: DataFrame, row_id: str = "doc_id", text: str = "text", k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, n_paths, paths, first_doc_id) for every longest span of words that are all in repeated k-mers.

    A k-mer, k words in a row without regard to case, signs and white space, is repeated if it stands at two places at least,
    of one document or of several; every place is listed, the first one too. Spans of one document don't touch. paths
    are the compacted nonbranching paths of the graph that the span runs through, in order, the same number for the same path
    anywhere, n_paths how many; first_doc_id is the least id of a document with the
    span's first k-mer. Rows equal in id and text are one document; rows without an id are searched too and have a null id.
    Ids may be of any type; where they aren't whole numbers, first_doc_id is that of the document whose id has the least hash.
    Null, empty and shorter texts have no span; texts may be of any length. Other columns aren't looked at, whatever their names.

    A k-mer is an edge from the node of its first to that of its last k - 1 words; a node with more than one repeated edge in
    or out branches. Successive edges with the same least anchor travel as one row, a super-k-mer. Only those whose anchor
    is found twice can hold a repeated edge, and of those with equal content only the first is spread out into edges, in the
    bucket of its anchor; edges go to the buckets of their nodes as well. In a bucket repeated edges are chained to pieces of
    paths, joins of the pieces by their end nodes compact these to whole paths, and the runs of repeated edges are joined to all
    places in the sources, whose coordinates then give the spans.
    """
    id_type = docs.schema[row_id].dataType
    whole_ids = isinstance(id_type, IntegralType)
    number = quoted(row_id).cast("long") if whole_ids else F.when(quoted(row_id).isNotNull(), F.xxhash64(quoted(row_id)))
    keyed = docs.select(F.xxhash64(quoted(row_id), quoted(text)).alias("row"), number.alias("id"), quoted(text).alias("text"))

    def runs_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        rows, ids = b.column(0).to_numpy(), _ids(b.column(1))
        for w in words(b.column(2)):
            start, _, least, content, _, _ = super_kmers(w.hash, w.at, k, anchor)
            if len(start):
                row = np.searchsorted(w.at, start, "right") - 1
                yield least.view(np.int64), content.view(np.int64), rows[w.first + row], ids[w.first + row], (start - w.at[row]).astype(np.int32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the super-k-mers of equal content in a batch one row, with its first and last place."""
        for b in batches:
            parts = list(runs_of(b))
            if not parts:
                continue
            m, c, row, ids, pos = (np.concatenate(x) for x in zip(*parts))
            # a hash of the place tells places apart; equal rows give equal places, which count once
            place = mix(row.view(np.uint64) + mix(pos.astype(np.uint64) + SECOND)).view(np.int64)
            order = np.lexsort((place, c, m))
            m, c, row, ids, pos, place = (x[order] for x in (m, c, row, ids, pos, place))
            first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])])
            last, least = np.r_[first[1:], len(m)] - 1, np.minimum.reduceat(ids, first)
            columns = [m[first], c[first], place[first], place[last], row[first], pos[first]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(least, mask=least == NO_ID)], names=["m", "c", "p", "q", "row", "pos", "id"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(0)):
                part = b.column(1).slice(w.first, w.rows)
                flat = part.flatten()
                at = np.repeat(w.at[:-1], part.value_lengths().to_numpy()) + flat.field("pos").to_numpy()
                start, n, least, content, before, after = super_kmers(w.hash, w.at, k, anchor)
                i = np.searchsorted(start, at)
                n, least, content, before, after = (x[i] for x in (n, least, content, before, after))
                words32 = (w.hash >> np.uint64(32)).astype(np.uint32)
                wide = words32.astype(np.uint64)
                edge, node = ngrams(wide, k).view(np.int64), ngrams(wide, k - 1).view(np.int64)
                raw = words32.tobytes()
                tokens = [raw[4 * s : 4 * (s + x + k - 1)] for s, x in zip(at.tolist(), n.tolist())]
                columns = [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), flat.field("times"), flat.field("first_id"), pa.array(tokens, pa.binary()), *(pa.nulls(len(at), t) for t in (pa.int64(), pa.int8(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
                for bucket, end, side, which in ((before, at, 1, at), (after, at + n, 0, at + n - 1)):
                    away = np.flatnonzero(bucket != least)
                    columns = [pa.array(bucket[away].view(np.int64)), pa.nulls(len(away), pa.int64()), flat.field("times").take(pa.array(away)), pa.nulls(len(away), pa.int64()), pa.nulls(len(away), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(node[end[away]]), pa.array(np.full(len(away), side, np.int8)), pa.array(edge[which[away]])], names=NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUCKET_ROWS:
                t = pa.Table.from_batches(held)
                m = t["m"].to_numpy()
                n = int(np.searchsorted(m, m[-1], "left"))
                yield from count_edges(t.slice(0, n), k) if n else ()
                held = t.slice(n).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from count_edges(pa.Table.from_batches(held), k)

    # each batch sends a content once, however often it holds it: a passage that very many rows have doesn't load its anchor's task
    contents = keyed.mapInArrow(sketch, "m long, c long, p long, q long, row long, pos int, id long").repartition("m").groupBy("m", "c")
    contents = contents.agg(F.min("p").alias("p"), F.max("q").alias("q"), F.min_by("row", "p").alias("row"), F.min_by("pos", "p").alias("pos"), F.min("id").alias("first_id"))
    anchors = Window.partitionBy("m")
    contents = contents.withColumn("low", F.min("p").over(anchors)).withColumn("high", F.max("q").over(anchors)).filter("low <> high")
    stands = written(contents.select("m", "c", "row", "pos", F.when(F.col("p") == F.col("q"), 1).otherwise(2).alias("times"), "first_id"), "super_kmers")
    taken = stands.groupBy("row").agg(F.collect_set(F.struct("pos", "times", "first_id")).alias("taken"))
    sources = keyed.select("row", "text").join(taken, "row").dropDuplicates(["row"]).select("text", "taken")
    edges = sources.mapInArrow(spread, SCHEMA).repartition("m").sortWithinPartitions("m")
    found = written(edges.mapInArrow(count, FOUND), "repeated")
    branching = found.filter("m IS NULL AND piece IS NULL").select("head", F.lit(1).alias("branch")).distinct()
    path_of = compact(found.filter("piece IS NOT NULL").select("piece", "head", "tail", "edges"), branching)
    # paths of each run, in order; the first one goes on from the run before if no branching node parts them
    through = found.filter("m IS NOT NULL").select("m", "c", "a", F.posexplode("parts").alias("nth", "piece")).join(path_of, "piece").groupBy("m", "c", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))
    paths = found.filter("m IS NOT NULL").select("m", "c", "a", "b", "head", "first_id").join(branching, "head", "left").join(through, ["m", "c", "a"]).select("m", "c", "a", "b", "paths", F.coalesce("branch", F.lit(0)).alias("branch"), "first_id")
    paths = written(paths, "paths")
    # only super-k-mers whose content may hold a repeated edge leave their task again
    places = sieve(paths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(places.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            for m, c, row, ids, pos in runs_of(b):
                at = np.flatnonzero(maybe[c.view(np.uint64) >> np.uint64(64 - int(len(maybe)).bit_length() + 1)])
                m, c, row, ids, pos = (x[at] for x in (m, c, row, ids, pos))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(c), pa.array(row), pa.array(ids, mask=ids == NO_ID), pa.array(pos)], names=["m", "c", "row", "id", "pos"])

    runs = keyed.mapInArrow(cut, "m long, c long, row long, id long, pos int")
    placed = runs.join(paths, ["m", "c"]).select("row", "id", (F.col("pos") + F.col("a")).alias("start"), (F.col("pos") + F.col("b")).alias("end"), "paths", "branch", "first_id")
    by_row = Window.partitionBy("row").orderBy("start")
    placed = placed.repartition("row").dropDuplicates(["row", "start"]).withColumn("before", F.lag("end").over(by_row))
    fresh = F.col("before").isNull() | (F.col("start") > F.col("before") + 1)
    placed = placed.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    passed = F.when((F.col("fresh") == 1) | (F.col("branch") == 1), F.col("paths")).otherwise(F.slice("paths", F.lit(2), F.size("paths")))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", passed.alias("paths")))), lambda x: x["paths"]))
    spans = placed.groupBy("row", "run").agg(F.min("id").alias("doc_id"), F.min("start").alias("start_word"), (F.max("end") + k).alias("end_word"), in_order.alias("paths"), F.min_by("first_id", "start").alias("first_doc_id"))
    spans = spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.size("paths").alias("n_paths"), "paths", "first_doc_id")
    if whole_ids:
        return spans.select(F.col("doc_id").cast(id_type).alias("doc_id"), "start_word", "end_word", "n_words", "n_paths", "paths", F.col("first_doc_id").cast(id_type).alias("first_doc_id"))
    spans = written(spans, "spans")
    of = lambda name: docs.select(number.alias(name), quoted(row_id).alias(f"{name}_own")).filter(F.col(name).isNotNull()).join(spans.select(name).distinct(), name, "left_semi").distinct()
    named = spans.join(of("doc_id"), "doc_id", "left").join(of("first_doc_id"), "first_doc_id", "left")
    return named.select(F.col("doc_id_own").alias("doc_id"), "start_word", "end_word", "n_words", "n_paths", "paths", F.col("first_doc_id_own").alias("first_doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
