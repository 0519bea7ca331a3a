import random

import numpy as np
import pyarrow as pa
import pytest

from tarnlight.llm import simhash_dedup as s


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 23, 60])
def test_bit_planes_give_all_near_pairs(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    for k in range(0, 300, 2):
        prints[k] = prints[(k * 7) % 300]
        for b in rng.integers(0, 128, rng.integers(0, radius + 3)):
            prints[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    stop = np.repeat([1, 2, 66, 131, 300], [1, 1, 64, 65, 169])
    got = {(int(i), int(j)) for a, b in s.near_pairs(prints, stop, radius) for i, j in zip(a, b)}
    far = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())
    assert got == {(i, j) for i in range(300) for j in range(i + 1, stop[i]) if far(i, j) <= radius}


def brute(ids, prints, some, radius):
    root = {i: i for i, x in zip(ids, some) if x and i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if some[a] and some[b] and ids[a] is not None and ids[b] is not None and int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {(i, find(i)) for i in root if find(i) != i}


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    texts = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for c in range(rng.choice([1, 1, 2, 6])):
            texts.append(" ".join(word() if c and rng.random() < 0.04 else w for w in base))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900 + k, texts[5]) for k in range(70)] + [(None, texts[5]), (800, None), (801, ""), (802, "!!"), (803, "!!"), (3, texts[3]), (804, "the of and"), (805, "The of. And")]
    column = pa.array([t for _, t in rows])
    prints, some = s.fingerprints(column)
    want = brute([i for i, _ in rows], prints, some, s.RADIUS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = s.near_duplicates(docs).collect()
    got = {(r.doc_id, r.duplicate_of) for r in found}
    assert len(found) == len(got) and len(got & want) >= 0.95 * len(want)
    root = dict(want)
    assert all(root.get(a, a) == root.get(b, b) for a, b in got)  # nothing is joined that brute force keeps apart
    kept = s.drop_near_duplicates(docs.selectExpr("*", "1 AS duplicate_id", "2 AS id", "3 AS f1")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if i not in dict(got))


def test_every_query_row_and_group_by_group():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (9, 2)).astype(np.uint64)
    prints = base[rng.integers(0, 9, 900)]
    for k in range(900):
        for b in rng.integers(0, 128, rng.integers(0, 16)):
            prints[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    key = np.sort(rng.integers(0, 4, 900))
    got = s.near_groups(key, prints, 9)
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    want = list(range(900))

    def find(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(900):
        for j in np.flatnonzero((far[i, :i] <= 9) & (key[:i] == key[i])):
            x, y = sorted((find(i), find(int(j))))
            want[y] = x
    assert got.tolist() == [find(i) for i in range(900)]


def test_full_buckets_are_spread(spark):
    """Half of all rows are near copies of one text, more than a cell holds; tables and cells forced to be small."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(3, 9)))
    one, other = ([word() for _ in range(300)] for _ in range(2))
    edited = lambda base: " ".join(word() if rng.random() < 0.02 else w for w in base)
    rows = [(i, edited(one)) for i in range(600)] + [(1000 + i, " ".join(word() for _ in range(60))) for i in range(500)] + [(2000 + i, edited(other)) for i in range(60)]
    got = {r.doc_id: r.duplicate_of for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bucket=64, cell=50).collect()}
    assert all(got.get(i) == 0 for i in range(1, 600)) and all(got.get(i) == 2000 for i in range(2001, 2060)) and not any(1000 <= i < 1500 for i in got)


def test_recall_at_every_distance(spark):
    """Pairs RADIUS bits apart at most are found with RECALL at least, where tables are needed."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
    other = base.copy()
    for k in range(2000):
        for b in rng.permutation(128)[: s.RADIUS]:
            other[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    both = np.concatenate([base, other]).view(np.int64)
    rows = [(i, int(f[0]), int(f[1])) for i, f in enumerate(both)]
    prints = spark.createDataFrame(rows, "id long, f1 long, f2 long")
    assert s.band_size(4000, bucket=64)[1] == 6
    found = {(r.a, r.b) for r in s.near_edges(prints, bucket=64).collect()}
    assert len(found) >= 0.93 * 2000 and all(b - a == 2000 for a, b in found)


@pytest.mark.parametrize("far", [0, 11, s.RADIUS])
def test_no_pair_is_lost(spark, far):
    """Every pair is linked at whatever distance up to RADIUS, none beyond it, in one piece and in many."""
    rng = np.random.default_rng(far)
    base = rng.integers(0, 1 << 63, (1500, 2)).astype(np.uint64)
    near, beyond = base.copy(), base.copy()
    for k in range(1500):
        for b in rng.permutation(128)[:far]:
            near[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        for b in rng.permutation(128)[: s.RADIUS + 1]:
            beyond[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    both = np.concatenate([base, near, beyond[:0] if far else beyond]).view(np.int64)
    prints = spark.createDataFrame([(i, int(f[0]), int(f[1])) for i, f in enumerate(both)], "id long, f1 long, f2 long")
    for sizes in ({}, {"bucket": 64, "cell": 300}):
        assert sorted((r.a, r.b) for r in s.near_edges(prints, **sizes).collect()) == [(i, 1500 + i) for i in range(1500)]


def test_groups_whose_least_members_are_far_apart(spark):
    """Chains of fingerprints of which each is near the next only: every link is needed, however they are dealt to pieces."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(40):
        f = rng.integers(0, 1 << 63, 2).astype(np.uint64)
        order = rng.permutation(128)
        for step in range(5):
            rows.append((step * 40 + g, *(int(x) for x in f.view(np.int64))))
            for b in order[step * s.RADIUS : (step + 1) * s.RADIUS]:
                f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    for sizes in ({}, {"bucket": 16, "cell": 20}):
        got = s.components(s.near_edges(spark.createDataFrame(rows, "id long, f1 long, f2 long"), **sizes)).collect()
        assert {(r.id, r.root) for r in got} == {(step * 40 + g, g) for g in range(40) for step in range(1, 5)}


@pytest.mark.parametrize("first", [0, 900])
@pytest.mark.parametrize("even", [True, False])
def test_buckets_give_the_groups_of_all_pairs(monkeypatch, first, even):
    monkeypatch.setattr(s, "WORTH", 9.0)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
    if not even:
        prints &= rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64) | np.uint64(0xFFFF0000FFFF)
    for k in range(0, 2000, 2):
        prints[k] = prints[int(rng.integers(0, 2000))]
        for b in rng.permutation(128)[: rng.integers(0, s.RADIUS + 3)]:
            prints[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    assert s.band_size(2000 - first, bucket=8)[0] > 1
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    left, right = np.nonzero(far <= s.RADIUS)
    apart = (left < (first or 2000)) & (right >= first)
    want = s.roots(2000, left[apart], right[apart])
    assert (s.near_groups(np.zeros(2000, int), prints, s.RADIUS, first, 8) == want).all() and (s.near_groups(np.zeros(2000, int), prints, s.RADIUS, first) == want).all()


def test_ids_of_any_type_and_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(3, 9))) for _ in range(120_000))
    rows = [("b", long), ("a", long + " end"), (None, long), ("c", "another text of its own"), ("a", None), ("a", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, row_key int, f1 string")
    rows_, key = s.with_row_key(docs)
    assert sorted(map(str, [tuple(r)[1:] for r in s.duplicate_rows(rows_, key).collect()])) == sorted(map(str, [("b", "a"), (None, "a")]))
    assert sorted(str(r.doc_id) for r in s.drop_duplicate_rows(docs).collect()) == ["a", "a", "a", "c"]


def test_edited_copies_are_near_and_others_far():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    base = [[word() for _ in range(200)] for _ in range(100)]
    edited = [[word() if rng.random() < 0.06 else w for w in b] for b in base]
    p, _ = s.fingerprints(pa.array([" ".join(b) for b in base + edited]))
    far = lambda a, b: int(np.bitwise_count(p[a] ^ p[b]).sum())
    assert np.mean([far(i, 100 + i) <= s.RADIUS for i in range(100)]) > 0.95
    assert all(far(i, j) > s.RADIUS for i in range(100) for j in range(i))


def test_empty_table_and_components(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    path = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    got = s.components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {(r.id, r.root) for r in got} == {(i, 0) for i in range(1, 31)} | {(51, 50), (52, 50)}
