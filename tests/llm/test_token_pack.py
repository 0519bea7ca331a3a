import base64
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import token_pack


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_unpack_reads_any_range(bits, data):
    ids = data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=60))
    packed = token_pack.pack(np.array(ids, np.uint32), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert token_pack.unpack(packed, bits, start, count).tolist() == ids[start : start + count]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_pack_against_one_big_number(bits, data):
    """Id i stands in bits i * bits ... of the payload read as one little-endian number."""
    ids = data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=60))
    want = sum(x << (i * bits) for i, x in enumerate(ids)).to_bytes(-(-len(ids) * bits // 8), "little")
    assert token_pack.pack(np.array(ids, np.uint32), bits) == want


def test_query_against_big_numbers(spark, tmp_path):
    """The whole query over a small table: every payload is the big number of the library's ids, and all documents are listed."""
    texts = [(i, "word " * i + "é" * (i % 7) if i % 5 else None, "x") for i in range(200)] + [(3, "again", "y"), (3, "again", "y")]
    spark.createDataFrame(texts, "doc_id long, text string, block string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with open(token_pack.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=token_pack.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = token_pack.query(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for i, t, _ in texts:
        by[i].append(coder.encode_ordinary(t or ""))
    shards = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.block)):
        number = int.from_bytes(r.payload, "little")
        shards[r.shard] += [number >> (i * r.bits) & ((1 << r.bits) - 1) for i in range(r.n_tokens)]
    seen = [(i, shards[r.shard][a : a + n]) for r in rows for i, a, n in zip(r.doc_ids, r.doc_starts, r.doc_lengths)]
    assert sorted(seen) == sorted((i, ids) for i, some in by.items() for ids in some) and sum(map(len, shards.values())) == sum(r.n_tokens for r in rows)


def test_width():
    assert [token_pack.width(n) for n in (1, 2, 3, 256, 257, 50256, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    with pytest.raises(ValueError):
        token_pack.pack(np.array([4], np.uint32), 2)


def test_documents_come_back(spark):
    texts = [(1, "one two three"), (2, None), (3, ""), (None, "no id"), (1, "one two three"), (5, "long " * 700), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = token_pack.pack_documents(docs, block_tokens=64).collect()
    shards = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.block)):
        shards[r.shard].append(r)
    with open(token_pack.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=token_pack.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = []
    for blocks in shards.values():
        assert all(r.n_tokens == 64 for r in blocks[:-1])
        assert [r.byte_offset for r in blocks] == np.cumsum([0] + [len(r.payload) for r in blocks])[:-1].tolist()
        for r in blocks:
            for i, start, n in zip(r.doc_ids, r.doc_starts, r.doc_lengths):
                got.append((i, coder.decode(token_pack.document(blocks, start, n, 64).tolist())))
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in texts], key=str)


def test_empty_table(spark):
    assert token_pack.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
