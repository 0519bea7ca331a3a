import random

import numpy as np
import pyarrow as pa
import tiktoken
from test_decontaminate import smith_waterman, words_of
from test_line_frequency import brute as lines_brute
from test_simhash_dedup import brute as groups_brute

import corpus_pipeline
from tarnlight.llm import byte_bpe, decontaminate, line_frequency, secret_scan, simhash_dedup


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    rows = {i: prose(rng.randrange(60, 200)) for i in range(150)}
    boiler = "read more on our site"
    for i in range(40):
        rows[i] += "\n" + boiler
    rows[200] = boiler  # depleted
    base = rows[10].split("\n")[0]
    rows[201] = base  # a copy of 10 but for the frequent line
    rows[202] = " ".join(word() if rng.random() < 0.03 else w for w in base.split(" "))
    for i in range(5):
        rows[300 + i] = prose(50) + " " + items[i][1].upper() + " " + prose(50)  # leaks
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows[400] = prose(50) + f' token = "{key}" ' + prose(50)
    table = [(i, t, "en", "src", len(t)) for i, t in rows.items()] + [(500, None, None, None, None)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) - set(got) == {200, 201, 202, *range(300, 305)} and 500 not in got
    assert all(r.exact for r in got.values())
    coder = byte_bpe.Coder(byte_bpe.load_vocabulary())
    text = {i: b.decode() for i, b in zip(got, coder.decode(pa.array([r.token_ids for r in got.values()], pa.list_(pa.int32()))).to_pylist())}
    assert text[400] == rows[400].replace(key, secret_scan.MASK)
    assert all(text[i] == rows[i].split("\n")[0] for i in range(40)) and all(text[i] == rows[i] for i in range(40, 150))


def test_against_brute_force(spark, tmp_path):
    """The rows of run() against all five stages done by loops over all lines, all pairs, all pairs of text and item, each candidate and the library's tokenizer."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(3)]
    rows = []
    for i in range(90):
        lines = [prose(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 3))] + (["all rights  RESERVED"] if rng.random() < 0.4 else [])
        if i % 11 == 0:
            lines[0] += " " + " ".join(word() if rng.random() < 0.1 else x for x in items[i % 3][1].split()) + " " + prose(10)
        if i % 13 == 0:
            lines.append(f'password = "{secret_scan._chars(rng, "0123456789abcdef", 40)}"')
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b"])))
    rows += [(200 + i, " ".join(word() if rng.random() < 0.02 else x for x in rows[i][1].split(" ")), rows[i][2]) for i in range(0, 40, 3)]
    rows += [rows[1], (300, None, "a"), (301, "", "b"), (302, "all rights reserved", "a")]
    table = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t) for i, t, *_ in lines_brute(rows, line_frequency.MIN_DOCS, line_frequency.MAX_SHARE, line_frequency.MIN_KEPT)]
    prints, some = simhash_dedup.fingerprints(pa.array([t for _, t in kept]))
    gone = dict(groups_brute([*range(len(kept))], prints, some, simhash_dedup.RADIUS))
    groups = {}
    for at in range(len(kept)):
        groups.setdefault(gone.get(at, at), []).append(at)
    kept = [kept[min(some, key=lambda at: (kept[at][0], at))] for some in groups.values()]
    score = lambda t, item: smith_waterman(words_of(item), words_of(t))
    least = lambda item: max(decontaminate.MIN_SCORE * decontaminate.MATCH * len(words_of(item)), decontaminate.MATCH * decontaminate.MIN_MATCHED)
    kept = [(i, t) for i, t in kept if all(score(t, item) < least(item) for _, item in items)]
    net, want = secret_scan.default_network(), []
    reference = tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.load_vocabulary(), special_tokens={})
    for i, t in kept:
        for a, b in sorted(((a, b) for a, b, p in secret_scan.scan(net, [t])[0] if p >= net.threshold), reverse=True):
            t = t[:a] + secret_scan.MASK + t[b:]
        want.append((i, reference.encode_ordinary(t)))
    got = [(r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and 60 < len(want) < 95


def test_very_long_repeated_and_clashing_rows(spark, tmp_path):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    long = " ".join(word() for _ in range(60_000)) + " " + "x" * 3000
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, long, "s", 7, 1.5), (1, long, "s", 7, 1.5), (2, long + " and more", "s", 8, 2.5), (3, None, None, None, None), (4, "", "s", 0, 0.0), (5, "short but whole text", None, 9, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key int, kept_text double").repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left = sorted(((r.doc_id, r.row_key, r.kept_text) for r in out.collect()), key=str)
        want = {"quality": [1, 1, 2, 5], "near_duplicates": [1, 3, 4, 5]}.get(name, [1, 1, 2, 3, 4, 5])
        assert [i for i, *_ in left] == want and all(x in [(r[0], r[3], r[4]) for r in rows] for x in left)
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).filter("exact OR token_ids IS NULL").collect()) == [1, 1, 2, 3, 4, 5]


def test_stages_keep_the_columns_and_the_order_of_names(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "one text of some words", "en", "s", 22)], schema)
    spark.createDataFrame([(1, "unlike anything else here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 1 and (name == "tokens" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_are_told_apart_without_their_ids(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    copied, repeated, orphan, item, clean, other = (prose(80) for _ in range(6))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(9, copied), (None, copied), (None, copied), (4, repeated), (4, repeated), (None, orphan), (None, orphan), (9, other), (7, copied)]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, row_key string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    out = stages["near_duplicates"](spark, make(rows), str(tmp_path))
    assert out.columns == make(rows).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(7, copied), (4, repeated), (None, orphan), (9, other)], key=str)
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(((r.doc_id, r.duplicate_of) for r in simhash_dedup.query(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted([(9, 7), (None, 7), (None, 7), (4, 4), (None, None)], key=str)
    leak = prose(30) + " " + item
    out = stages["decontamination"](spark, make([(None, leak), (3, leak), (3, clean), (None, other)]), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, clean), (None, other)], key=str)


def test_no_near_duplicate_is_lost(spark):
    """The rows that the stage keeps are those of brute force over all pairs, with more different texts than one bucket holds."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randrange(3, 9)))
    texts = [[word() for _ in range(30)] for _ in range(3000)]
    texts += [[word() if rng.random() < 0.08 else w for w in t] for t in texts[:1600]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    prints, _ = simhash_dedup.fingerprints(pa.array([t for _, t in rows]))
    far = np.concatenate([np.bitwise_count(prints[i : i + 200, None] ^ prints[None]).sum(axis=2) for i in range(0, len(rows), 200)])
    root = simhash_dedup.roots(len(rows), *np.nonzero(far <= simhash_dedup.RADIUS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert 500 < len(rows) - len(kept) and kept == sorted(set(root.tolist()))
