import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnlight.llm import debruijn_spans, decontaminate, simhash_dedup
from tarnlight.llm.textnp import hash_word, words


def split(*texts):
    out = []
    for w in words(pa.array(texts)):
        all_words = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
        assert [hash_word(x) for x in all_words] == w.hash.tolist()
        out += [all_words[a:b] for a, b in zip(w.at, w.at[1:])]
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("“Curly” l’homme—dash… no break　wide", ["curly", "l", "homme", "dash", "no", "break", "wide"]),
        ("Größe naïve нет", ["größe", "naïve", "нет"]),
        ("été 1² ❤️ ok", ["été", "1²", "ok"]),
        ("हिन्दी में", ["हिन्दी", "में"]),
        ("我们，今天abc学习。3本", ["我", "们", "今", "天", "abc", "学", "习", "3", "本"]),
        ("がく がく カタ", ["が", "く", "が", "く", "カ", "タ"]),
        ("ที่นี่", ["ที่", "นี่"]),
        ("한국어 문장", ["한국어", "문장"]),
        ("𠀀𠀁x", ["𠀀", "𠀁", "x"]),
    ],
)
def test_words(text, want):
    assert split(text, None, text, "") == [want, [], want, []]


def test_rows_part_words():
    assert split("ab", "cd", "é", "é", "天", "天", "天x") == [["ab"], ["cd"], ["é"], ["é"], ["天"], ["天"], ["天", "x"]]


@pytest.fixture(scope="module")
def chinese():
    rng = random.Random(3)
    return lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) + rng.choice([""] * 12 + ["，", "。"]) for _ in range(n))


def test_repeated_passage_without_spaces(spark, chinese):
    passage = chinese(60)
    plain = re.sub("[，。]", "", passage)
    docs = spark.createDataFrame([(1, chinese(200) + passage + chinese(200)), (2, chinese(99) + plain + chinese(9)), (3, chinese(300))], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in debruijn_spans.repeated_spans(docs).collect()} == {1: 60, 2: 60}


def test_other_quotes_and_spaces_are_the_same_passage(spark):
    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "“" + " ".join(w[:30]) + "”—" + "… ".join(w[30:]))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words) for r in debruijn_spans.repeated_spans(docs).collect()) == [(1, 60), (2, 60)]


def test_verbatim_item_without_spaces(spark, chinese):
    item = chinese(40)
    docs = spark.createDataFrame([(1, chinese(300) + item + chinese(300)), (2, chinese(600))], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(1, 7, 1.0)]


def test_edited_copies_without_spaces(chinese):
    texts = [chinese(400) for _ in range(20)]
    p, _ = simhash_dedup.fingerprints(pa.array(texts + ["天" + t[:100] + "地" + t[101:] for t in texts]))
    far = lambda a, b: int(np.bitwise_count(p[a] ^ p[b]).sum())
    assert all(far(i, 20 + i) <= simhash_dedup.RADIUS for i in range(20))
    assert all(far(i, j) > simhash_dedup.RADIUS for i in range(20) for j in range(i))
