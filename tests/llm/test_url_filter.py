import numpy as np
import pyarrow as pa

from tarnlight.llm import url_filter


def test_urls_hosts_and_parents(spark):
    entries = spark.createDataFrame([("a.com/x",), ("bad.org",), ("sub.c.net",), (None,), ("",), ("a.com/x",), ("d.com/q?id=1",)], "entry string")
    index = url_filter.build_index(entries)
    cases = {
        "http://www.A.com/X/": "a.com/x",
        "https://user@a.com:443/x#frag": "a.com/x",
        "http://a.com/x?y=1": "a.com/x",
        "a.com/x": "a.com/x",
        "http://a.com/xy": None,
        "http://deep.sub.bad.org/p": "bad.org",
        "http://bad.org:8080/p": "bad.org",
        "http://c.net/": None,
        "http://x.sub.c.net": "sub.c.net",
        "http://notbad.org/": None,
        "http://d.com/q?id=1": "d.com/q?id=1",
        "http://d.com/q?id=2": None,
        "": None,
        None: None,
        "http://long.com/" + "z" * 100_000: None,
    }
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(cases)] + [(0, "http://www.A.com/X/", "kept")], "page_id long, url string, blocked_by string").repartition(3)
    got = url_filter.filter_urls(pages, index)
    assert got.columns == ["page_id", "url", "blocked_by", "_blocked_by"]
    rows = got.collect()
    assert len(rows) == len(cases) + 1
    assert all(r._blocked_by == cases[r.url] and r.blocked_by == "kept" for r in rows)


def test_many_entries_against_a_set(spark):
    listed = {f"h{i}.com/p{i % 7}" for i in range(0, 3000, 3)}
    index = url_filter.build_index(spark.createDataFrame([(x,) for x in listed], "entry string").repartition(4))
    assert len(index.parts) >= 1
    pages = spark.createDataFrame([(i, f"http://h{i}.com/p{i % 7}") for i in range(3000)], "page_id long, url string")
    assert {r.page_id for r in url_filter.filter_urls(pages, index).filter("blocked_by IS NOT NULL").collect()} == set(range(0, 3000, 3))


def test_equal_digests_are_told_apart(tmp_path):
    path = str(tmp_path / "part")
    url_filter._put(path + ".keys", np.array([5, 7, 7, 7, 9], np.int64).tobytes())
    table = pa.table({"entry": pa.array(["a", "b", "c", "d", "e"], pa.large_string())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    url_filter._put(path + ".entries", out.getvalue())
    index = url_filter.DigestIndex([(path, 5, 9)])
    assert index.probe(np.array([7, 7, 7, 5, 5, 8, 99, -1]), pa.array(["d", "x", "b", "a", "b", "e", "e", "a"])).tolist() == [True, False, True, True, False, False, False, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "entry string")
    pages = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.build_index(none)).first().blocked_by is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.build_index(none)).count() == 0
