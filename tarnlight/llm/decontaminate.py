"""Operator 2, benchmark decontamination: rare n-grams of test items seed alignments with training texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import free_name, quoted, read, with_row_key, written
from tarnlight.llm.textnp import WORD_BASE, mix, words

#: Lengths of the seeds, in words.
SEED_WORDS = (2, 3, 4)
#: An n-gram is rare if the product of its words' shares of all corpus words is at most this. A share, so that a word of any corpus
#: meets equally many seeds by chance, and work grows with the corpus, not faster.
RARE = 1e-9
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage is a leak from this share of the item's best possible score, and from as much as MIN_MATCHED words in a row give.
MIN_SCORE, MIN_MATCHED = 0.4, 6
#: Items of fewer words can't be told from ordinary text: they are not looked for.
MIN_ITEM_WORDS = 8
#: Items with more words than this in all are looked for in parts, so that a task holds the seeds of one part only.
PART_WORDS = 2_000_000
#: Different words whose counts a task holds at a time.
HELD_WORDS = 1 << 20


def item_words(items: DataFrame, row_id: str, text: str) -> DataFrame:
    """(n, item, tokens): a number of each item's own, its id, the hashes of its words; rows that repeat an id stay apart."""
    given = items.select(F.monotonically_increasing_id().alias("n"), quoted(row_id).alias("item"), quoted(text).alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2)):
                lists = pa.ListArray.from_arrays(pa.array(w.at.astype(np.int32)), pa.array(w.hash.view(np.int64)))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.rows), b.column(1).slice(w.first, w.rows), lists], names=["n", "item", "tokens"])
                yield out.filter(pa.array(np.diff(w.at) >= MIN_ITEM_WORDS))

    return given.mapInArrow(split, f"n long, item {given.schema['item'].dataType.simpleString()}, tokens array<long>")


def sieve(keys: np.ndarray) -> np.ndarray:
    """For the highest 20 bits of a hash: whether one of the keys has them."""
    out = np.zeros(1 << 20, bool)
    out[keys >> np.uint64(44)] = True
    return out


def gram(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row: the same for the same words anywhere."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(WORD_BASE) + h[i : len(h) - k + 1 + i])
    return out


def word_counts(docs: DataFrame, text: str, tokens: DataFrame) -> tuple[DataFrame, int]:
    """(word, count) of the items' words in all texts, as far as they stand there, and the number of words of all texts."""
    item_word = tokens.select(F.explode("tokens").alias("word")).distinct()
    # at most as many rows as the sieve has places
    maybe = np.zeros(1 << 20, bool)
    maybe[[r.place for r in item_word.select(F.shiftrightunsigned("word", 44).alias("place")).distinct().collect()]] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for w in words(b.column(0)):
                total += len(w.hash)
                own, times = np.unique(w.hash[maybe[w.hash >> np.uint64(44)]], return_counts=True)
                held, which = np.unique(np.concatenate([held, own]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([n, times]), minlength=len(held)).astype(np.int64)
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": held.view(np.int64), "count": n})
                    held, n = held[:0], n[:0]
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.view(np.int64)), "count": pa.array(n)})
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "count": pa.array([total], pa.int64())})

    counts = written(docs.select(quoted(text).alias("t")).mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "word_counts")
    total = counts.filter("word IS NULL").first()
    return counts.join(item_word, "word", "left_semi"), total["count"] if total else 0


def seeds_of(t: np.ndarray, p: np.ndarray, rare: float) -> list[tuple[int, int]]:
    """(place, length) of an item's seeds: n-grams whose logarithms p of its words' shares add up to rare's at most, none of which
    holds a shorter one; all of the longest n-grams where none is rare."""
    out: list[tuple[int, int]] = []
    begins: dict[int, np.ndarray] = {}
    for k in SEED_WORDS:
        m = len(t) - k + 1
        if m < 1:
            break
        good = sum(p[i : i + m] for i in range(k)) <= np.log(rare)
        for shorter, at in begins.items():
            for i in range(k - shorter + 1):
                good &= ~at[i : i + m]
        begins[k] = good
        out += [(int(i), k) for i in np.flatnonzero(good)]
    k = min(len(t), max(SEED_WORDS))
    return out or [(i, k) for i in range(len(t) - k + 1)]


def seeds(tokens: DataFrame, counts: DataFrame, total: int, rare: float) -> DataFrame:
    """(n, gram, at, length): each seed of each item, by the hash of its words, its place in the item, and the item's words."""
    placed = tokens.select("n", F.posexplode("tokens").alias("i", "word")).join(counts, "word", "left")
    share = F.log(F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)) / F.lit(float(max(total, 1))))
    shares = placed.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("i", share.alias("p")))).alias("p"))
    rows = tokens.select("n", "tokens").join(shares, "n").select("n", "tokens", F.transform("p", lambda x: x["p"]).alias("p"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for n, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t, p = t.values.to_numpy().view(np.uint64), p.values.to_numpy()
                grams = {k: gram(t, k).view(np.int64) for k in SEED_WORDS}
                out += [(n, int(grams[k][i]), i, len(t)) for i, k in seeds_of(t, p, rare)]
            n, g, at, length = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "gram": pa.array(g, pa.int64()), "at": pa.array(at, pa.int32()), "length": pa.array(length, pa.int32())})

    return rows.mapInArrow(find, "n long, gram long, at int, length int")


def slack(length):
    """Words that a passage may have more than its item on either side of where a seed puts it."""
    return length // 4 + 4


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that overlap within a group as one, from windows sorted by group and start: the first window of each, its start and end."""
    big = int(end.max()) + 1
    order = np.cumsum(np.r_[True, group[1:] != group[:-1]])
    reach = np.maximum.accumulate(end + order * big) - order * big
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    return first, start[first], np.maximum.reduceat(end, first)


def align(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over many pairs at once: the best local score of each row of a against its row of b, and where it ends in a and b.

    a, b: word hashes, rows padded to one length. Rows of the matrix are computed together for all pairs; within a row the
    gap along b is a running maximum, as gaps cost the same for every word.
    """
    n, m = a.shape[0], b.shape[1]
    step = np.arange(m + 1, dtype=np.int32) * -GAP
    h = np.zeros((n, m + 1), np.int32)
    best, end_a, end_b = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    b_in = np.arange(m)[None, :] < b_len[:, None]
    for i in range(a.shape[1]):
        same = (a[:, i : i + 1] == b) & b_in & (i < a_len)[:, None]
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + step, axis=1) - step
        new[:, 1:][~b_in] = 0
        new[i >= a_len] = 0
        h = new
        at = h.argmax(axis=1)
        top = h[np.arange(n), at]
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i + 1, at[better]
    return best, end_a, end_b


def aligned(items: list[np.ndarray], passages: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, start and end of the best alignment of each item with its passage; start and end only where the score is at least least."""
    n = len(items)
    score, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), int(size.max())), np.uint64)
        for x, r in enumerate(rows):
            out[x, : len(r)] = r
        return out, size

    order = np.argsort([len(p) for p in passages], kind="stable")
    for part in np.array_split(order, -(-n // 256)):
        got, end_a, end_b = align(*padded([items[j] for j in part]), *padded([passages[j] for j in part]))
        score[part], end[part] = got, end_b
        # the same backwards from the end gives the start
        good = np.flatnonzero((got >= least[part]) & (got > 0))
        if len(good):
            _, _, back = align(*padded([items[part[x]][: end_a[x]][::-1] for x in good]), *padded([passages[part[x]][: end_b[x]][::-1] for x in good]))
            start[part[good]] = end_b[good] - back
    return score, start, end


def leaks(
    docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rare: float = RARE, min_score: float = MIN_SCORE
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for each document and test item with an alignment of at least min_score.

    score is the Smith-Waterman score as a share of the item's best possible one (1 for a verbatim copy), start_word and
    end_word where the alignment starts and ends in the document; of several the best, of equal ones the first. Seeds are the
    item's n-grams of two to four words whose expected frequency, from the shares of their words among all words of the corpus,
    is at most rare; an n-gram that holds a shorter seed is left out. So what counts as rare doesn't change when a leaked
    passage is copied many times. An item whose n-grams are all common is found by its longest n-grams. Items of fewer than
    MIN_ITEM_WORDS words, null and empty ones are not looked for. Null and empty texts leak nothing; texts may be of any
    length; ids may be of any type, and rows without one are found, with a null id; repeated rows give one row. Other columns
    aren't looked at, whatever their names.

    A text is read twice: for the counts of the items' words, and for passages, the surroundings of all its seeds. Only these
    travel: they join the items by the seeds' hashes, and each pair of passage and item is aligned once. Nothing is collected
    but what a task must hold to find passages: the hashes of a part's seeds, in parts of bounded size.
    """
    kinds = docs.schema[row_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, start_word int, end_word int"
    tokens = written(item_words(items, item_id, item_text), "items")
    parts = -(-(tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0) // PART_WORDS)
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    counts, total = word_counts(docs, text, tokens)
    all_seeds = written(seeds(tokens, counts, total, rare).withColumn("part", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")), "seeds")
    given = docs.select(quoted(row_id).alias("doc_id"), quoted(text).alias("text"))
    found = [_leaks_of(given, tokens, all_seeds.filter(F.col("part") == n).drop("part"), min_score) for n in range(parts)]
    return reduce(DataFrame.union, found).select("doc_id", F.col("item").alias("item_id"), "score", "start_word", "end_word").distinct()


def _leaks_of(docs: DataFrame, tokens: DataFrame, part: DataFrame, min_score: float) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    room = slack_column(F.col("length"))
    reach = part.groupBy("gram").agg(F.max(F.col("at") + room).alias("before"), F.max(F.col("length") - F.col("at") + room).alias("after")).toArrow()
    order = np.argsort(reach["gram"].to_numpy().view(np.uint64))
    grams = reach["gram"].to_numpy().view(np.uint64)[order]
    before, after = (reach[c].to_numpy()[order].astype(np.int64) for c in ("before", "after"))
    maybe = sieve(grams)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passage = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        for b in batches:
            for w in words(b.column(1)):
                row = w.row_of()
                places = []
                for k in SEED_WORDS:
                    g = gram(w.hash, k)
                    where = np.flatnonzero(maybe[g >> np.uint64(44)])
                    where = where[row[where] == row[where + k - 1]]
                    at = np.searchsorted(grams, g[where])
                    at[at == len(grams)] = 0
                    hit = grams[at] == g[where]
                    places.append(np.stack([where[hit], at[hit]], axis=1))
                where, at = np.concatenate(places).T
                if len(where):
                    start, end = np.maximum(where - before[at], w.at[row[where]]), np.minimum(where + after[at], w.at[row[where] + 1])
                    o = np.lexsort((start, row[where]))
                    where, at, start, end = where[o], at[o], start[o], end[o]
                    first, begin, stop = merged(row[where], start, end)
                    own = row[where[first]]
                    flat = np.concatenate([w.hash[x:y] for x, y in zip(begin, stop)]).view(np.int64)
                    hits = pa.StructArray.from_arrays([pa.array(grams[at].view(np.int64)), pa.array((where - np.repeat(begin, np.diff(np.r_[first, len(where)]))).astype(np.int32))], names=["gram", "pos"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(passage + np.arange(len(first))),
                            pa.array(key + w.first + own),
                            b.column(0).take(pa.array(w.first + own)),
                            pa.array((begin - w.at[own]).astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(stop - begin)].astype(np.int32)), pa.array(flat)),
                            pa.ListArray.from_arrays(pa.array(np.r_[first, len(where)].astype(np.int32)), hits),
                        ],
                        names=["passage", "row", "doc_id", "first_word", "words", "hits"],
                    )
                    passage += len(first)
            key += b.num_rows

    passages = written(docs.mapInArrow(find, f"passage long, row long, doc_id {kind}, first_word int, words array<long>, hits array<struct<gram:long,pos:int>>"), "passages")
    # a part of the items has a bounded number of seeds
    hits = passages.select("passage", F.explode("hits").alias("h")).select("passage", "h.gram", "h.pos").join(F.broadcast(part.select("gram", "n", "at")), "gram")
    pairs = hits.groupBy("passage", "n").agg(F.collect_set(F.col("pos") - F.col("at")).alias("places"))
    pairs = pairs.join(passages.drop("hits"), "passage").join(tokens, "n")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, texts, owner, offset = [], [], [], []
            for x, (places, passage, item) in enumerate(zip(b.column(0), b.column(1), b.column(2))):
                t, p = item.values.to_numpy().view(np.uint64), passage.values.to_numpy().view(np.uint64)
                at = np.sort(places.values.to_numpy()).astype(np.int64)
                _, begin, stop = merged(np.zeros(len(at), np.int64), np.maximum(at - slack(len(t)), 0), np.minimum(at + len(t) + slack(len(t)), len(p)))
                for i, j in zip(begin, stop):
                    items.append(t), texts.append(p[i:j]), owner.append(x), offset.append(int(i))
            if not items:
                continue
            best = np.array([MATCH * len(t) for t in items])
            least = np.maximum(np.ceil(best * min_score - 1e-9), MATCH * MIN_MATCHED)
            got, start, end = aligned(items, texts, least)
            good = np.flatnonzero(got >= least)
            take, shift = pa.array(np.array(owner)[good]), np.array(offset)[good] + b.column(3).to_numpy()[np.array(owner)[good]]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in (4, 5, 6, 7)), pa.array(got[good] / best[good]), pa.array((shift + start[good]).astype(np.int32)), pa.array((shift + end[good]).astype(np.int32))],
                names=["row", "n", "doc_id", "item", "score", "start_word", "end_word"],
            )

    item_kind = tokens.schema["item"].dataType.simpleString()
    found = pairs.select("places", "words", "tokens", "first_word", "row", "n", "doc_id", "item").mapInArrow(score, f"row long, n long, doc_id {kind}, item {item_kind}, score double, start_word int, end_word int")
    best = F.max_by(F.struct("doc_id", "item", "score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("b")
    return found.groupBy("row", "n").agg(best).select("b.*")


def slack_column(length):
    """slack() of a column."""
    return F.floor(length / 4) + 4


def drop_leaks(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents in which leaks() finds a test item; rows without an id stay."""
    name = free_name(docs, "leaking_id")
    found = written(leaks(docs, items, row_id, text).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(found, quoted(row_id) == F.col(name), "left_anti")


def drop_leaking_rows(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows in which leaks() finds a test item, those without an id too; no row goes for another's id.

    Null and empty texts stay, repeated rows all stay or all go; columns may have any names.
    """
    rows, key = with_row_key(docs)
    return drop_leaks(rows, items, key, text).select(*(quoted(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
