import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tarnlight.llm import debruijn_spans


def brute(rows, k):
    """Spans by dictionary; (doc_id, start, end, first doc)."""
    docs = [(i, re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())) for i, t in sorted(set(rows), key=str)]
    places, owners, nexts, prevs = Counter(), defaultdict(list), defaultdict(set), defaultdict(set)
    for i, w in docs:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            places[g] += 1
            owners[g].append(i)
    for g, n in places.items():
        if n > 1:
            nexts[g[:-1]].add(g)
            prevs[g[1:]].add(g)
    out = []
    for i, w in docs:
        on = [places[tuple(w[p : p + k])] > 1 for p in range(len(w) - k + 1)] + [False]
        start, paths = None, 0
        for p, x in enumerate(on):
            if x:
                node = tuple(w[p : p + k - 1])
                if start is None:
                    start, paths = p, 1
                elif len(nexts[node]) > 1 or len(prevs[node]) > 1:
                    paths += 1
            elif start is not None:
                out.append((i, start, p - 1 + k, p - 1 + k - start, paths, min((o for o in owners[tuple(w[start : start + k])] if o is not None), default=None)))
                start = None
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and a in to".split()) if rng.random() < 0.5 else f"w{rng.randrange(500)}é"
    passages = [[word() for _ in range(n)] for n in (9, 10, 11, 30, 60)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w[at:at] = p[a:] if rng.random() < 0.5 else p
        text = " ".join(x.upper() if rng.random() < 0.1 else x for x in w).replace(" the ", "\n the, ")
        rows.append((i, text))
    rows += [rows[3], rows[4], (None, rows[5][1]), (100, None), (101, ""), (102, "same " * 40), (102, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = debruijn_spans.repeated_spans(docs, k=10, anchor=5).collect()
    assert sorted([(*r[:5], r[6]) for r in found], key=str) == brute(rows, 10)
    # the same stretch of words has the same paths, different stretches of a path's words never do
    words = {i: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) for i, t in rows if i != 102}
    of, stretch = defaultdict(set), defaultdict(set)
    for r in found:
        assert len(r.paths) == r.n_paths
        if r.doc_id in words and r.doc_id is not None:
            text = " ".join(words[r.doc_id][r.start_word : r.end_word])
            of[text].add(tuple(r.paths))
            if len(r.paths) == 1:
                stretch[r.paths[0]].add(text)
    assert all(len(p) == 1 for p in of.values())
    # of one path the stretches lie in its longest one or overlap it
    for some in stretch.values():
        longest = max(some, key=len)
        assert all(x.split(" ")[:10] == longest.split(" ")[:10] or " ".join(x.split(" ")[:10]) in longest or " ".join(longest.split(" ")[:10]) in x for x in some)


def test_chains():
    first, place = debruijn_spans.chains(np.array([3, -1, 0, 1, 6, -1, 4, 7]))
    assert first.tolist() == [2, 2, 2, 2, 4, 5, 4, 7] and place.tolist() == [1, 3, 0, 2, 0, 0, 1, 0]
    n = 1000
    first, place = debruijn_spans.chains(np.r_[np.arange(1, n), -1])
    assert first.tolist() == [0] * n and place.tolist() == list(range(n))


def test_pieces_of_a_long_path_become_one(spark):
    """Thirty pieces that follow each other, two that part at a branching node, and a closed path."""
    rows = [(100 + i, i, i + 1, 3) for i in range(30)] + [(200, 50, 51, 1), (201, 51, 52, 1), (300, 70, 71, 1), (301, 71, 70, 1)]
    pieces, branching = spark.createDataFrame(rows, "piece long, head long, tail long, edges long"), spark.createDataFrame([(51,)], "head long")
    got = dict(map(tuple, debruijn_spans.compact(pieces, branching).collect()))
    assert got == {100 + i: 100 for i in range(30)} | {200: 200, 201: 201, 300: 300, 301: 301}


def test_a_passage_in_every_document_and_ids_of_any_type(spark):
    """A hot passage, another that follows it in half of the documents, ids that are texts, a very long text, clashing names."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    hot, more = ([word() for _ in range(n)] for n in (70, 40))
    rows = [(f"d{i}", " ".join([word() for _ in range(rng.randrange(5, 30))] + hot + (more if i % 2 else [])) + " " + word()) for i in range(200)]
    rows += [("long", " ".join(word() for _ in range(150_000)) + " " + " ".join(hot)), (None, " ".join(hot)), ("d3", rows[3][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, text string, row string, m int").repartition(4)
    got = sorted(tuple(r)[:5] for r in debruijn_spans.repeated_spans(docs).select(F.coalesce("doc_id", F.lit("-")), "start_word", "end_word", "n_words", "n_paths", "first_doc_id").collect())
    want = set()
    for i, t in set(rows):
        w = t.split(" ")
        at = w.index(hot[0])
        n = 110 if i and i.startswith("d") and int(i[1:]) % 2 else 70
        want.add((i or "-", at, at + n, n))
    assert [g[:4] for g in got] == sorted(want)
    first = {r.first_doc_id for r in debruijn_spans.repeated_spans(docs).collect()}
    assert len(first) == 1 and first <= {i for i, _ in rows}


def test_driver_gets_no_row_for_each_content(spark, monkeypatch):
    """However many contents are repeated, the driver gets a row for each 64 places of a sieve at most."""
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    rows += [(1000 + i, "again " + t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(debruijn_spans, "SIEVE", 10, raising=False)
    monkeypatch.setattr(type(docs), "collect", lambda self: got.append(collect(self)) or got[-1])
    spans = debruijn_spans.repeated_spans(docs, k=10, anchor=5)
    assert sum(map(len, got)) <= 16
    monkeypatch.undo()
    assert sorted(((*r[:5], r[6]) for r in spans.collect()), key=str) == brute(rows, 10)


def test_empty_table(spark):
    assert debruijn_spans.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
