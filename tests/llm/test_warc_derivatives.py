import gzip
import hashlib

from tarnlight.llm import warc_derivatives

HTML = '<html><head><title>A &amp; B\n c</title><style>p{}</style><script>var x="</p>";</script></head><body><!-- no --><p>One&nbsp;two</p><a class=x href="/l?a=1&amp;b">li<b>nk</b></a> &lt;3 &#39;q&#39; &eacute; 1 < 2</body>'


def test_records_are_linked_and_digested(spark):
    rows = [(1, "http://a/x", HTML), (2, None, None), (None, "http://b/", ""), (1, "http://a/x", HTML), (3, "http://c/", "<p>" + "w " * 200_000 + "<script>never closed")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    responses = warc_derivatives.responses(pages)
    got = warc_derivatives.derive(responses).collect()
    assert len(got) == 2 * len(rows)
    known = {r.record_id: r for r in responses.collect()}
    for r in got:
        source = known[r.refers_to]
        assert (r.target_uri, r.source_headers, r.source_digest, r.warc_date) == (source.target_uri, source.http_headers, source.payload_digest, source.warc_date)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.content.encode()).hexdigest() and r.content_length == len(r.content.encode())
        assert r.record_id not in known
    text = {(r.page_id, r.warc_type): r.content for r in got}
    assert text[1, "conversion"] == "A & B\nc\nOne two\nlink <3 'q' é 1 < 2"
    assert "title: A &amp; B c\r\n" in text[1, "metadata"] and "outlink: /l?a=1&amp;b L a/@href\r\n" in text[1, "metadata"]
    assert text[2, "conversion"] == "" and text[3, "conversion"] == ("w " * 200_000).strip()
    assert {r.source_digest for r in got if r.page_id == 2} == {"sha256:" + hashlib.sha256(b"").hexdigest()}


def test_entities_links_and_quoted_signs(spark):
    html = "<p title='a > b'>&eacute;&#233;&#xE9;&#x1F600;&#0;&#xD800;&#128;&bogus;&amp;lt; R&D &amp &#12345678;</p><a href='one'>x</a><A HREF = two>y</a><a data-href=\"no\" class=\"x>y\" href=\"three\">z</a><img href=w>"
    html += "<p " + "x='1' " * 20_000 + ">end" + "&amp;" * 3000
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = {r.warc_type: r.content for r in warc_derivatives.derive(warc_derivatives.responses(pages)).collect()}
    assert got["conversion"] == "ééé😀��€&bogus;&lt; R&D &amp &#12345678;\nxyz\nend" + "&" * 3000
    assert [x for x in got["metadata"].split("\r\n") if x.startswith("outlink")] == [f"outlink: {x} L a/@href" for x in ("one", "two", "three")]


def test_reading_warc_files(spark, tmp_path):
    def record(kind, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Target-URI: http://a/é", "WARC-Date: 2024-05-05T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9"
    packed = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("<p>zip é".encode())
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>ab\r\n2\r\ncd\r\n0\r\n\r\n"
    parts = [record("warcinfo", b"software: x\r\n"), record("response", plain, "WARC-Payload-Digest: sha1:ABC"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", packed), record("response", chunked), record("response", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc_derivatives.read_responses(spark, [str(tmp_path / n) for n in ("a.warc", "b.warc.gz", "c.warc")])
    rows = found.collect()
    assert sorted(r.payload for r in rows) == sorted(["<p>café", "<p>zip é", "<p>abcd"] * 2)
    assert {r.payload_digest for r in rows if r.payload == "<p>café"} == {"sha1:ABC"} and {r.warc_date for r in rows} == {"2024-05-05T00:00:00Z"}
    derived = warc_derivatives.derive(found).collect()
    assert {r.content for r in derived if r.warc_type == "conversion"} == {"café", "zip é", "abcd"} and {r.refers_to for r in derived} == {r.record_id for r in rows}


def test_record_bytes(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>é</p>")], "page_id long, url string, html string")
    rows = warc_derivatives.record_bytes(warc_derivatives.derive(warc_derivatives.responses(pages))).filter("warc_type = 'conversion'").collect()
    head, body = bytes(rows[0].record).split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and body == "é\r\n\r\n".encode()
    assert fields["WARC-Refers-To"] == f"<{rows[0].refers_to}>" and fields["Content-Length"] == "2"


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, content string, record_id int")
    assert warc_derivatives.derive(warc_derivatives.responses(pages)).count() == 0
    one = spark.createDataFrame([(1, "u", "<p>x", "other", 7)], pages.schema)
    assert {r.content for r in warc_derivatives.derive(warc_derivatives.responses(one)).collect()} >= {"x"}
