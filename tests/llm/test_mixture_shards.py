import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from tarnlight.llm import mixture_shards


def brute(rows, shards, seed):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    first = lambda v: (v is not None, v if v is not None else 0)
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    placed = []
    for s, mine in by.items():
        mine.sort(key=lambda r: (md5(f"{seed}:{r[0] if r[0] is not None else ''}"), first(r[0]), (r[1] is not None, md5(r[1]) if r[1] is not None else "")))
        placed += [(Fraction(2 * k + 1, 2 * len(mine)), (s is not None, s or ""), r) for k, r in enumerate(mine)]
    placed.sort(key=lambda p: p[:2])
    n, out, used = len(placed), [], Counter()
    for at, (_, _, r) in enumerate(placed):
        shard = at * shards // n
        out.append((*r, shard, used[shard]))
        used[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("grid", [500, 0])
def test_against_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(mixture_shards, "GRID_STRATA", grid)
    rng = random.Random(3)
    rows = [(i, f"text {i}", rng.choice(["big"] * 7 + ["mid"] * 2 + ["rare", None])) for i in range(211)]
    rows += [rows[0], rows[0], (None, None, "mid"), (None, "x", "mid"), (7, None, "big"), (9, "", None), (8, "y" * 100_000, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((tuple(r) for r in mixture_shards.assign_shards(docs, shards=8, seed=5).collect()), key=str)
    assert got == brute(rows, 8, 5)
    share = Counter(r[2] for r in rows)
    for s in range(8):
        mine = Counter(r[2] for r in got if r[3] == s)
        assert all(abs(mine[k] - n / 8) <= 2 for k, n in share.items())


def test_clashing_names_empty_table_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "s", 5, 6, 0, 0), (2, "b", "s", 7, 8, 0, 0)], "doc_id long, text string, source string, shard int, Shard_Row int, Stratum_rows int, nth_row int")
    got = mixture_shards.assign_shards(docs, shards=2)
    assert got.columns == [*docs.columns, "_shard", "_shard_row"]
    assert {(r.doc_id, r.shard) for r in got.collect()} == {(1, 5), (2, 7)}
    assert mixture_shards.assign_shards(docs.limit(0), shards=2).count() == 0
    plain = mixture_shards.assign_shards(docs.drop("shard", "Shard_Row"), shards=2)
    mixture_shards.write_shards(plain, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
