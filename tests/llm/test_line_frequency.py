import random
import re
from collections import defaultdict

import pytest

from tarnlight.llm import line_frequency


def norm(line):
    return re.sub(r"[ \t\r\f\x0b]+", " ", line.lower()).strip(" ")


def brute(rows, min_docs, max_share, min_kept):
    seen, docs = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        docs[host].add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                seen[host, norm(line)].add(text)
    out = []
    for i, text, host in rows:
        if text is None:
            continue
        bad = {n for (h, n), t in seen.items() if h == host and len(t) > min_docs and len(t) > max_share * len(docs[host])}
        new = "\n".join(x for x in text.split("\n") if norm(x) not in bad)
        size = lambda t: len(re.sub(r"\s+", "", t))
        if size(new) and size(new) >= min_kept * size(text):
            out.append((i, new, host, len(new)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "broadcast_lines"), [(0, 500_000), (1, 500_000), (2, 0)])
def test_against_brute_force(spark, seed, broadcast_lines):
    rng = random.Random(seed)
    common = ["Share this", "  share   THIS ", "all rights reserved", "é è", ""]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own\t line {rng.randrange(60)}" for _ in range(rng.randrange(0, 6))]
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [rows[3], rows[3], (None, None, "a"), (500, "", "a"), (501, " \n ", "b"), (502, "long " * 20_000, None), (502, "Share this", None)]
    docs = spark.createDataFrame([(i, t, h, len(t) if t is not None else None) for i, t, h in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    got = line_frequency.clean_lines(docs, min_docs=4, max_share=0.1, min_kept=0.3, broadcast_lines=broadcast_lines)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 0.1, 0.3)


def test_copies_do_not_make_their_lines_frequent(spark):
    rows = [(i, "first line of a copied text\nits second line", "a") for i in range(300)]
    assert line_frequency.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 300


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x y", "a", 1, "k")], "doc_id long, text string, source string, bad_lines int, Bad_Host string")
    got = line_frequency.clean_lines(docs)
    assert got.columns == docs.columns and got.count() == 1
    assert line_frequency.clean_lines(docs.limit(0)).count() == 0
