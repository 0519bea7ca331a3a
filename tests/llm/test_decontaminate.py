import random
import re

import numpy as np
import pytest

from tarnlight.llm import decontaminate as d


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def smith_waterman(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (d.MATCH if x == y else d.MISMATCH), above[j + 1] + d.GAP, row[j] + d.GAP))
        best, above = max(best, max(row)), row
    return best


def test_alignment_against_the_recurrence():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 6, (60, 12)).astype(np.uint64), rng.integers(1, 6, (60, 25)).astype(np.uint64)
    n, m = rng.integers(1, 13, 60), rng.integers(1, 26, 60)
    got, _, _ = d.align(a, n, b, m)
    assert got.tolist() == [smith_waterman(a[i, : n[i]].tolist(), b[i, : m[i]].tolist()) for i in range(60)]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    rare = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    word = lambda: rng.choice("the of and a in to is".split()) if rng.random() < 0.45 else rare()
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 50)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "the of"), (53, items[0][1])]
    docs = []
    for n in range(300):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if n % 5 == 0:
            copy = words_of(items[n // 5 % 12][1])
            p = rng.choice([0, 0.1, 0.2])
            copy = [word() if rng.random() < p else x for x in copy]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if rng.random() < 0.1 else x for x in copy]
        docs.append((n, " ".join(w)))
    docs += [(None, "x " + items[1][1]), (400, None), (401, ""), (0, docs[0][1]), (402, "start " * 60_000 + items[2][1])] + [(500 + k, "same copy " + items[3][1]) for k in range(60)]
    return docs, items


def test_against_alignment_of_every_pair(spark, made):
    docs, items = made
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    want = {}
    for i, text in set(docs):
        w = words_of(text)
        for j, item in items:
            x = words_of(item)
            if len(x) >= d.MIN_ITEM_WORDS and w:
                score = smith_waterman(x, w[-300:]) / (d.MATCH * len(x))
                if score >= d.MIN_SCORE and score * len(x) >= d.MIN_MATCHED:
                    want[i, j] = score
    found = {(r.doc_id, r.item_id): r.score for r in got}
    assert len(want.keys() & found.keys()) >= 0.95 * len(want) and not found.keys() - want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in found.keys() & want.keys())


def test_where_the_alignment_lies():
    rng = np.random.default_rng(2)
    item = rng.integers(1, 1 << 60, 20).astype(np.uint64)
    noise = lambda n: rng.integers(1 << 61, 1 << 62, n).astype(np.uint64)
    passages = [np.concatenate([noise(7), item, noise(5)]), np.concatenate([noise(3), item[4:17], noise(30)]), item, np.concatenate([noise(2), item[:10], noise(1), item[10:]])]
    got = d.aligned([item] * 4, passages, np.full(4, 10))
    assert [x.tolist() for x in got] == [[40, 26, 40, 39], [7, 3, 0, 2], [27, 16, 20, 23]]


def test_seeds_against_the_rule():
    rng = np.random.default_rng(4)
    for _ in range(50):
        t, p = rng.integers(0, 9, rng.integers(1, 30)).astype(np.uint64), -rng.random(30) * 9
        p, own = p[: len(t)], []
        for k in d.SEED_WORDS:
            own += [(i, k) for i in range(len(t) - k + 1) if sum(p[i : i + k]) <= np.log(1e-6) and not any(i <= j and j + m <= i + k for j, m in own if m < k)]
        k = min(len(t), 4)
        assert d.seeds_of(t, p, 1e-6) == (own or [(i, k) for i in range(len(t) - k + 1)])


def test_short_items_drop_nothing_and_ids_of_any_type(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    item = words(20)
    bench = spark.createDataFrame([("yes", "Yes"), ("long", item), ("word", "the answer is four")], "item_id string, text string")
    rows = [(f"d{i}", f"yes the answer is four {words(30)}") for i in range(20)] + [("x", words(10) + " " + item + " " + words(10)), ("x", words(10) + " " + item + " " + words(10)), ("y", item + " " + words(200) + " " + item)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id string, text string, words string").repartition(3)
    got = {(r.doc_id, r.item_id, r.start_word, r.end_word, r.score) for r in d.leaks(docs, bench).collect()}
    assert got == {("x", "long", 10, 30, 1.0), ("y", "long", 0, 20, 1.0)}
    assert d.drop_leaks(docs, bench).count() == 20 and d.drop_leaking_rows(docs, bench).count() == 20


def test_a_passage_in_very_many_documents_and_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_WORDS", 30)
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    items = [(i, words(25)) for i in range(4)]
    rows = [(i, words(20) + " " + items[i % 4][1] + " " + words(20)) if i % 3 else (i, words(60)) for i in range(300)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()} == {(i, i % 4) for i in range(300) if i % 3}


def test_drop_and_empty_tables(spark, made):
    docs, items = made
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    gone = {r.doc_id for r in d.leaks(table, bench).collect()}
    clash = table.selectExpr("*", "1 AS leaking_id", "2 AS item_id", "3 AS score")
    assert d.drop_leaks(clash, bench).columns == clash.columns
    assert sorted(str(r.doc_id) for r in d.drop_leaks(clash, bench).collect()) == sorted(str(i) for i, _ in docs if i is None or i not in gone)
    assert d.leaks(table.limit(0), bench).count() == 0 and d.leaks(table, bench.limit(0)).count() == 0
