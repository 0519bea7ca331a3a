"""Operator 6, SimHash near-dedup: 128-bit fingerprints compared bit plane by bit plane, many documents at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import free_name, quoted, read, with_row_key, written
from tarnlight.llm.textnp import WORD_BASE, mix, words

BITS = 128
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Documents whose fingerprints differ in at most RADIUS bits are near duplicates.
RADIUS = 23
#: Fingerprints of a piece, of which one task compares two; with fewer in all MIN_PIECES pieces if these still have LEAST of them.
CELL, MIN_PIECES, LEAST = 1 << 18, 8, 4096
#: In a task fingerprints lie in buckets of about BUCKET by at most MAX_BITS of their bits.
BUCKET, MAX_BITS, SEED = 256, 16, 6
#: Queries and words of 64 rows that are compared at a time.
QUERIES, WORDS = 64, 128
#: Pairs of a tile or of several that are joined to groups before more are listed.
DENSE = 1 << 12
#: Share of all comparisons up to which passing over the others is worth its cost.
WORTH = 0.2


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each text as two uint64 columns, and whether it has a word at all.

    Each different word of a text votes once, with a weight that grows with its length in bytes (0 up to 2, then length - 2,
    at most 6), so that neither the short words which all texts share nor the common words of long texts pull fingerprints
    together. In a text of such short words only, all weigh alike. In scripts without spaces two characters in a row vote in
    place of a word, with the weight of their bytes, as single ones recur in all texts.
    """
    n = len(column)
    prints, some = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    for w in words(column):
        if not len(w.hash):
            continue
        row, h = w.row_of(), w.hash
        pair = np.flatnonzero(w.alone[:-1] & w.alone[1:] & (w.end[:-1] == w.start[1:]) & (row[:-1] == row[1:]))
        last = w.end.copy()
        last[pair] = w.end[pair + 1]
        h = h.copy()
        h[pair] = mix(w.hash[pair] * np.uint64(WORD_BASE) + w.hash[pair + 1])
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        row, h = row[order], h[order]
        own = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
        row, h, order = row[own], h[own], order[own]
        weight = np.clip(last[order] - w.start[order] - 2, 0, 6).astype(np.int16)
        light = np.bincount(row, weights=weight, minlength=w.rows) == 0
        weight[light[row]] = 1
        keep = weight > 0
        h, weight, row = h[keep], weight[keep], row[keep]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sums = np.add.reduceat(weight.astype(np.int32), first)
        for half in range(2):
            bits = np.unpackbits((h if half == 0 else mix(h + np.uint64(0x9E3779B97F4A7C15))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits * weight[:, None], first, axis=0, dtype=np.int32)
            packed = np.packbits(votes * 2 > sums[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            prints[w.first + row[first], half] = packed
        some[w.first + row[first]] = True
    return prints, some


def reaches(parts: int, radius: int) -> list[int]:
    """For each of the parts of a fingerprint a number of bits, so that of any two at most radius bits apart one part differs in no more.

    Else the parts would differ in one bit more each, radius + 1 in all.
    """
    least, more = divmod(radius - parts + 1, parts)
    return [least + 1] * more + [least] * (parts - more)


def band_size(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[int, int]:
    """(parts, bits): n fingerprints lie in 2**bits buckets by so many bits of a part; of all numbers of parts that of the least comparisons."""
    bits = min(MAX_BITS, max(0, (-(-n // bucket) - 1).bit_length()))
    if bits == 0:
        return 1, 0
    cost = lambda parts: sum(math.comb(bits, d) for reach in reaches(parts, radius) for d in range(reach + 1))
    return min(range(1, min(radius + 1, BITS // bits) + 1), key=cost), bits


class Planes:
    """Fingerprints as bit planes: word w of plane b has bit b of rows 64 w to 64 w + 63.

    Queries are compared with 64 rows a word at once: each plane, flipped where the query's bit is set, is added into a counter
    whose digits are bit planes too. Sums are carry-save: a plane waits at its digit for the next one, and both are reduced with
    the digit to a sum and a carry. The counter starts at 2**d - 1 - radius, so that a carry out of its highest digit means
    "beyond the radius"; such rows are dead. The most balanced planes come first; when nearly all rows are dead, after
    2 radius + 34 of them, the others' whole fingerprints decide.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        n = len(prints)
        self.prints, self.radius, self.words = prints, radius, -(-n // 64)
        bits = np.zeros((self.words * 64, BITS), np.uint8)
        bits[:n] = np.unpackbits(prints.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
        self.order = np.argsort(np.abs(bits.sum(axis=0, dtype=np.int64) * 2 - n), kind="stable")[: 2 * radius + 34]
        self.planes = np.stack([np.packbits(np.ascontiguousarray(bits[:, b]), bitorder="little").view(np.uint64) for b in self.order])

    def near(self, query: np.ndarray, word: np.ndarray | slice, alive: np.ndarray, group: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place in query, row) of all rows alive (a word for each query and word of rows) at most radius bits from query fingerprints.

        With groups, those of the queries and those of all rows, pairs of one group may be left out; alive is changed.
        """
        flips = np.ascontiguousarray(np.unpackbits(query.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")[:, self.order].T).astype(np.uint64) * ONES
        digits = int(self.radius).bit_length()
        offset = (1 << digits) - 1 - self.radius
        planes = self.planes[:, word]
        counter = [np.full(alive.shape, ONES if offset >> d & 1 else 0, np.uint64) for d in range(digits)]
        waiting: list[np.ndarray | None] = [None] * digits
        free = [np.empty_like(alive) for _ in range(digits + 3)]
        for x in range(len(planes)):
            plane, d = np.bitwise_xor(flips[x][:, None], planes[x], out=free.pop()), 0
            while d < digits and waiting[d] is not None:
                one, two, carry = counter[d], waiting[d], free.pop()
                np.bitwise_and(one, two, out=carry)
                np.bitwise_xor(one, two, out=one)
                np.bitwise_and(one, plane, out=two)
                np.bitwise_or(carry, two, out=carry)
                np.bitwise_xor(one, plane, out=one)
                waiting[d] = None
                free += [two, plane]
                plane, d = carry, d + 1
            if d < digits:
                waiting[d] = plane
            else:
                np.bitwise_and(alive, np.bitwise_not(plane, out=plane), out=alive)
                free.append(plane)
        for d in range(digits):
            if waiting[d] is not None:
                plane = waiting[d]
                for e in range(d, digits):
                    counter[e], plane = counter[e] ^ plane, counter[e] & plane
                alive &= ~plane
        number = np.arange(word.start, word.stop) if isinstance(word, slice) else word
        if group is not None and int(np.bitwise_count(alive).sum()) > DENSE:
            row = np.minimum(number[:, None] * 64 + np.arange(64), len(self.prints) - 1).ravel()
            alive &= ~np.packbits(group[0][:, None] == group[1][row], axis=1, bitorder="little").view(np.uint64)
        at, where = np.nonzero(alive)
        which, bit = np.nonzero(np.unpackbits(alive[at, where].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left, right = at[which], number[where[which]] * 64 + bit
        near = np.bitwise_count(query[left] ^ self.prints[right]).sum(axis=1) <= self.radius
        return left[near], right[near]


def below(x: np.ndarray) -> np.ndarray:
    """The lowest x bits of a word."""
    x = np.clip(x, 0, 64).astype(np.uint64)
    return np.where(x == 64, ONES, (np.uint64(1) << (x % np.uint64(64))) - np.uint64(1))


def near_pairs(prints: np.ndarray, stop: np.ndarray, radius: int, first: int = 0, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j < stop[i], whose fingerprints differ in at most radius bits; stop must not fall. With first only i < first <= j.

    With groups, which the caller may change meanwhile, pairs of one group may be left out.
    """
    planes = Planes(prints, radius)
    for a in range(0, first or len(prints), QUERIES):
        query = np.arange(a, min(a + QUERIES, first or len(prints)))
        for low in range(max(a + 1, first) // 64, (int(stop[query[-1]]) + 63) // 64, WORDS):
            word = np.arange(low, min(low + WORDS, planes.words))
            alive = below(stop[query][:, None] - word * 64) & ~below(np.maximum(query + 1, first)[:, None] - word * 64)
            left, right = planes.near(prints[query], slice(low, low + len(word)), alive, None if group is None else (group[query], group))
            if len(left):
                yield query[left], right


def banded_pairs(prints: np.ndarray, radius: int, first: int, bucket: int, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As near_pairs() of one key, with (i, j), (j, i) or both, and some more than once; only rows that are near in some part are compared.

    A fingerprint's bits are dealt out to parts. For each of them rows are sorted by a few of its bits, and a row is compared
    with the buckets that differ in no more of these than reaches() says: any two rows at most radius bits apart are so compared
    in one part at least. If bits are so uneven that this takes nearly as many comparisons as all pairs, all are compared.
    """
    n = len(prints)
    queries, rows = np.arange(first or n), np.arange(first, n)
    parts, bits = band_size(len(rows), radius, bucket)
    dealt = np.random.default_rng(SEED).permutation(BITS)
    all_keys, masks = [], []
    for p, reach in enumerate(reaches(parts, radius)):
        key = np.zeros(n, np.int64)
        for b in dealt[p::parts][:bits]:
            key = key << 1 | (prints[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).astype(np.int64)
        all_keys.append(key)
        masks.append(np.flatnonzero(np.bitwise_count(np.arange(1 << bits)) <= reach))
    counts = [(np.bincount(k[queries], minlength=1 << bits), np.bincount(k[rows], minlength=1 << bits)) for k in all_keys]
    compared = sum(int(left @ right[np.arange(1 << bits) ^ m]) for (left, right), mask in zip(counts, masks) for m in mask)
    if compared > WORTH * len(queries) * len(rows):
        yield from near_pairs(prints, np.full(n, n), radius, first, group)
        return
    for key, mask in zip(all_keys, masks):
        query, row = queries[np.argsort(key[queries], kind="stable")], rows[np.argsort(key[rows], kind="stable")]
        starts, begins = (np.searchsorted(key[x], np.arange((1 << bits) + 1)) for x in (row, query))
        planes = Planes(np.ascontiguousarray(prints[row]), radius)
        whole = below(len(row) - np.arange(planes.words) * 64)
        for k in np.flatnonzero(np.diff(begins)):
            others = k ^ mask
            others = np.sort(others[(starts[others + 1] > starts[others]) & ((others >= k) | (first > 0))])
            low = starts[others] // 64
            size = (starts[others + 1] + 63) // 64 - low
            words = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            words = words[np.r_[True, words[1:] != words[:-1]]] if len(words) else words
            step = max(QUERIES, 2 * QUERIES * WORDS // max(1, len(words)))
            for a in range(begins[k], begins[k + 1], step):
                q = query[a : min(a + step, begins[k + 1])]
                for w in range(0, len(words), WORDS):
                    word = words[w : w + WORDS]
                    left, right = planes.near(prints[q], word, np.tile(whole[word], (len(q), 1)), (group[q], group[row]))
                    if len(left):
                        yield q[left], row[right]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each row's group, rows being joined by left[k] - right[k]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_groups(key: np.ndarray, prints: np.ndarray, radius: int, first: int = 0, bucket: int | None = None) -> np.ndarray:
    """For rows sorted by key the least row of each row's group: the groups of a key are the connected parts of "at most radius bits apart".

    With first only rows before it are compared with rows from it on; with a bucket all are of one key, and lie in buckets. Pairs
    that join two groups are kept until there are DENSE of them and then make the groups one. No list of all pairs is ever held,
    however many rows are near each other.
    """
    n = len(key)
    root = np.arange(n)
    group = root.copy()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> None:
        left, right = (np.concatenate(x) for x in zip(*held))
        held.clear()
        group[:] = roots(n, np.r_[np.arange(n), left], np.r_[group, right])

    pairs = near_pairs(prints, np.searchsorted(key, key, "right"), radius, first, group) if bucket is None else banded_pairs(prints, radius, first, bucket, group)
    for left, right in pairs:
        fresh = group[left] != group[right]
        if fresh.any():
            held.append((left[fresh], right[fresh]))
            if sum(len(x) for x, _ in held) >= DENSE:
                join()
    if held:
        join()
    return group


def edges_of(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by cell and side, cells whole: in each cell an edge (a, b), a < b, from one member of each group to each other one.

    A cell with rows of both sides compares those of one with those of the other, a cell with one side compares all its rows.
    """
    rest: list[pa.RecordBatch] = []

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, side, ids = (t[c].to_numpy() for c in ("cell", "side", "id"))
        prints = np.ascontiguousarray(np.stack([t["f1"].to_numpy(), t["f2"].to_numpy()], axis=1)).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
            group = near_groups(cell[a:b], prints[a:b], radius, int(np.searchsorted(side[a:b], 1)) % (b - a), bucket)
            moved = np.flatnonzero(group != np.arange(b - a))
            if len(moved):
                one, other = ids[a + group[moved]], ids[a + moved]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(one, other), "b": np.maximum(one, other)})

    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= 1 << 16 and rest[0]["cell"][0] != batch["cell"][-1]:
                t = pa.Table.from_batches(rest)
                n = int(np.searchsorted(t["cell"].to_numpy(), batch["cell"][-1].as_py(), "left"))
                yield from compare(t.slice(0, n))
                rest = t.slice(n).to_batches()
    if rest:
        yield from compare(pa.Table.from_batches(rest))


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (a, b) that isn't its component's least node: (id, root).

    Alternating large-star and small-star steps until nothing changes; each step's edges are written to the shared folder.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(size) == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = tuple(size)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(least, large.b == least.n).select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).filter("m <> b").select(F.col("m").alias("a"), "b").distinct()
        now = written(small, "edges")


def near_edges(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """(a, b): links between fingerprints (id, f1, f2) that join all pairs which are at most radius bits apart, and no others, a < b.

    No pair is lost. Fingerprints are dealt out by a hash of their ids to pieces of about cell of them, and each two pieces are
    compared in one task, each piece with itself in another. So tasks are alike in size however many fingerprints are alike, and
    none ever holds more than two pieces. Within a task banded_pairs() passes over the pairs that can't be near.
    """
    n = prints.count()
    pieces = max(-(-n // cell), min(MIN_PIECES, n // LEAST), 1)
    own = F.col("own")
    dealt = prints.select("id", "f1", "f2", F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("other"))
    cells = dealt.select((F.least("own", "other") * pieces + F.greatest("own", "other")).alias("cell"), (own > F.col("other")).cast("byte").alias("side"), "id", "f1", "f2")
    # by ranges of their numbers, as a hash of so few cells would load some tasks with several
    return cells.repartitionByRange(pieces * (pieces + 1) // 2, "cell").sortWithinPartitions("cell", "side").mapInArrow(lambda it: edges_of(it, radius, bucket), "a long, b long")


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """(doc_id, duplicate_of) for every document that has a near duplicate with a smaller id; duplicate_of is the least id of its group.

    row_id is a column of whole numbers; duplicate_rows() takes any. Groups are the connected parts of the relation
    "fingerprints differ in at most radius bits". Texts without a word (null, empty, signs only) and rows without an id are
    never duplicates. Rows that repeat an id count as one document: the first by fingerprint stands for it in comparisons. Of
    exact copies one fingerprint is compared, for all of them. Texts may be of any length, other columns are not looked at.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, some = fingerprints(b.column(1))
            keep = pa.array(some)
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(f[:, 0]).filter(keep), pa.array(f[:, 1]).filter(keep)], names=["id", "f1", "f2"])

    all_prints = written(docs.select(quoted(row_id).cast("long").alias("id"), quoted(text).alias("text")).filter("id IS NOT NULL").mapInArrow(prints, "id long, f1 long, f2 long"), "fingerprints")
    copies = written(all_prints.groupBy("f1", "f2").agg(F.min("id").alias("id")), "distinct_fingerprints")
    same = all_prints.join(copies.withColumnRenamed("id", "a"), ["f1", "f2"]).select("a", F.col("id").alias("b"))
    return components(near_edges(copies, radius, bucket, cell).union(same)).select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates() finds: of each group the least id stays; rows without an id stay."""
    name = free_name(docs, "duplicate_id")
    gone = near_duplicates(docs, row_id, text).select(F.col("doc_id").alias(name))
    return docs.join(gone, quoted(row_id).cast("long") == F.col(name), "left_anti")


def duplicate_rows(docs: DataFrame, row_key: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, duplicate_of) for every row but one of each group of near duplicates; row_key is a number of each row's own.

    All rows are compared, those without an id or with another row's too. Of each group the row of the least id stays, one
    without an id only where all are; duplicate_of is its id. Ids may be of any type that has an order. Repeated rows are
    duplicates of each other; texts without a word are of none; texts may be of any length.
    """
    found = near_duplicates(docs, row_key, text).select(F.col("doc_id").alias("row"), F.col("duplicate_of").alias("group"))
    members = written(found.union(found.select("group", "group").distinct()), "groups")
    ids = docs.select(quoted(row_key).alias("row"), quoted(row_id).alias("id"))
    ids = written(members.join(ids, "row"), "groups")
    stays = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return ids.join(stays, "group").filter("row <> first.row").select(F.col("row").alias("row_key"), F.col("id").alias("doc_id"), F.col("first.id").alias("duplicate_of"))


def drop_duplicate_rows(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that duplicate_rows() finds: of each group one row stays, and no row goes for another's id.

    Null, empty and wordless texts all stay. Columns may have any names.
    """
    rows, key = with_row_key(docs)
    # written, so that its true size decides on the join: estimated, it has the texts shuffled
    gone = written(duplicate_rows(rows, key, row_id, text).select(F.col("row_key").alias(key)), "gone")
    return rows.join(gone, key, "left_anti").select(*(quoted(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = with_row_key(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return duplicate_rows(rows, key).select("doc_id", "duplicate_of")
