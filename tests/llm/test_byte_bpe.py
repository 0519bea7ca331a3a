import random

import pyarrow as pa
import pytest
import tiktoken

from tarnlight.llm import byte_bpe


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def texts():
    rng = random.Random(0)
    fixed = ["Hello  world", None, "", "a\n\n b\t\tc  ", "x" * 70_001, "ab" * 333 + "c", "é" * 501, " " * 5000 + "x", "=-" * 777, "ééé ñ 日本語　x  y 'll it's", " lead", "trail ", "<|endoftext|> hi", "\r\n\r\n a", "a b", "\x0bz \x1c"]
    return fixed + ["".join(rng.choice("ab é\n\t'sll 12.%日 　") for _ in range(40)) for _ in range(200)] + ["the quick brown fox " * 3000]


def test_same_ids_as_the_library_and_back(vocabulary, reference):
    coder = byte_bpe.Coder(vocabulary)
    given = texts()
    ids = coder.encode(pa.array(given))
    assert ids.to_pylist() == [None if t is None else reference.encode_ordinary(t) for t in given]
    assert [x if x is None else x.decode() for x in coder.decode(ids).to_pylist()] == given
    again = coder.encode(pa.array(given[5:40]))
    assert again.to_pylist() == ids.slice(5, 35).to_pylist()


def test_long_words(vocabulary, reference, monkeypatch):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    given = ["a" * 5000, "=" * 3001, "the" * 2000, "".join(rng.choice(letters) for _ in range(20_000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))]
    given += ["".join(rng.choice(rng.choice([letters, "theinra", "eta", "ab"])) for _ in range(rng.randint(65, 400))) for _ in range(60)]
    coder = byte_bpe.Coder(vocabulary)
    want = [reference.encode_ordinary(t) for t in given]
    assert coder.encode(pa.array(given)).to_pylist() == want
    monkeypatch.setattr(byte_bpe, "QUERY_IDS", 700)
    assert [x.decode() for x in coder.decode(pa.array(want, pa.list_(pa.int32()))).to_pylist()] == given


def test_cuts_change_nothing(vocabulary):
    coder = byte_bpe.Coder(vocabulary)
    for word in ("日本語の文章" * 30, "straße" * 40, "qzxjvkw" * 30):
        assert b"".join(coder._cut(word.encode())) == word.encode()


def test_decoding_many_long_rows(spark):
    rows = spark.range(300).selectExpr("id", "transform(sequence(1, 21000), x -> int(x % 200)) AS token_ids")
    assert byte_bpe.decode(rows).selectExpr("count(decoded)").first()[0] == 300


def test_forgetting_words_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 200)
    given = [f"word{i} other{i % 9} ünï{i % 5}" for i in range(60)]
    assert byte_bpe.Coder(vocabulary).encode(pa.array(given)).to_pylist() == [reference.encode_ordinary(t) for t in given]


def test_a_tiny_vocabulary_merges_leftmost_first():
    vocabulary = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258}
    coder = byte_bpe.Coder(vocabulary)
    plain = tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    given = ["aaa", "aaab", "aaaa", "baab", "ab" * 50, "a" * 99 + "b", "a" * 100 + "b"]
    assert coder.encode(pa.array(given)).to_pylist() == [plain.encode_ordinary(t) for t in given]
    with pytest.raises(ValueError):
        byte_bpe.Coder({b"a": 0})


def test_tables(spark, reference):
    rows = [(1, "one two", "x"), (2, None, "y"), (None, "", None), (1, "one two", "x"), (3, "z " * 150_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(2)
    coded = byte_bpe.encode(docs)
    assert coded.columns == [*docs.columns, "_token_ids"]
    back = byte_bpe.decode(coded, "_token_ids").collect()
    assert sorted(((r.doc_id, r.decoded, r.token_ids) for r in back), key=str) == sorted(rows, key=str)
    trip = byte_bpe.round_trip(docs).collect()
    assert all(r.exact or r.token_ids is None for r in trip) and len(trip) == 5
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([([1, 99_999_999],), ([None],), (None,), ([],), ([233],)], "token_ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(bad).collect()][:4] == [None, None, None, ""]
