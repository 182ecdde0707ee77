import gzip
import json
import random
import time

from strandline.llm import warc as w


def response(uri="http://a.example/x/y?z=1", page="<p>hi", **more):
    return w.response_record(uri, page.encode(), "1", "2020-01-02T03:04:05Z")


def test_records_round_trip():
    made = [([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("X", "a: b")], b"one\r\n\r\nWARC/1.0"), ([("WARC-Type", "metadata")], b""), ([("WARC-Type", "resource"), ("X", "ü")], bytes(range(256)))]
    raw = [w.write_record(h, b) for h, b in made]
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw)), gzip.compress(b"".join(raw))):
        got = list(w.read_records(data))
        assert [([x for x in h if x[0] != "Content-Length"], b) for _, h, b in got] == made
        assert [at for at, *_ in got] == [0, len(raw[0]), len(raw[0]) + len(raw[1])]
    folded = b"WARC/1.0\r\nWARC-Type: x\r\nLong: a\r\n  b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert w.header(next(iter(w.read_records(folded)))[1], "long") == "a b"


def test_faults():
    good = response()
    for bad in (b"junk", good[:-40], good + b"more", good[:30], gzip.compress(good)[:-9], b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        try:
            list(w.read_records(bad))
        except w.Malformed:
            continue
        raise AssertionError(bad[:40])


def test_records_before_a_fault():
    raw = [response(f"http://a.example/{i}", "<p>" + "x" * (300 * i)) for i in range(20)]
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw)), gzip.compress(b"".join(raw))):
        got = []
        try:
            for _, headers, _ in w.read_records(data[:-30]):
                got.append(w.header(headers, "WARC-Target-URI"))
        except w.Malformed:
            pass
        assert got == [f"http://a.example/{i}" for i in range(len(got))] and len(got) >= 18


def test_time_grows_with_the_members():
    """Eight times as many members take about eight times as long, not sixty-four times."""

    def seconds(n):
        data = gzip.compress(w.write_record([("WARC-Type", "resource")], random.Random(1).randbytes(2000))) * n
        began = time.process_time()
        assert sum(1 for _ in w.read_records(data)) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.01)


def test_chunks():
    r = random.Random(2)
    big = r.randbytes(300_000) + bytes(40_000_000)  # unpacks to far more than its bytes
    packed = gzip.compress(big) + gzip.compress(b"") + gzip.compress(b"end")
    parts = list(w.plain_chunks(packed + b"plain"))
    assert b"".join(parts) == big + b"endplain" and max(map(len, parts)) <= 1 << 24


def test_text_and_links():
    page = """<!DOCTYPE html><html><head><title>T &amp; u</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><!-- no <b>text</b> --><h1 title="a > b">Head</h1><p>One <b>two</b>&nbsp;three<br>four &lt;x&gt; 1 < 2<p>five
    <a HREF='/up?a=1&amp;b=2'>six</a><img src=pic.png></body><script>open"""
    assert w.plain_text(page) == "T & u\nHead\nOne two three\nfour <x> 1 < 2\nfive\nsix"
    assert w.page_links(page, "http://h.example/d/e") == [{"path": "A@/href", "url": "http://h.example/up?a=1&b=2"}, {"path": "IMG@/src", "url": "http://h.example/d/pic.png"}]
    assert w.plain_text("") == "" and w.plain_text("<a href=\"x" * 5000).startswith("<a")


def test_long_attribute_values():
    data = "data:image/png;base64," + "QUJD" * 50_000
    page = f"""<p>one<img src="{data}">two<a title='{data}' href=/x>three</a><script src="{data}">var t;</script><p>four"""
    assert w.plain_text(page) == "onetwothree\nfour"
    assert [x["path"] for x in w.page_links(page, "http://h.example/")] == ["IMG@/src", "A@/href"]
    assert w.plain_text("<a href='" + "x" * 300_000).startswith("<a")


def test_http():
    body = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    assert w.http_parts(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)[2] == b"hello world"
    assert w.http_parts(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"zip"))[2] == b"zip"
    assert w.http_parts(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot")[2] == b"not"
    assert w.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and w.decoded("é".encode(), "text/html; charset=none-such") == "é"


def test_derivatives_are_linked():
    ((_, headers, block),) = w.read_records(response(page="<title>t</title><p>x<p>y"))
    (meta, envelope), (conv, text) = w.derive(headers, block)
    source = w.header(headers, "WARC-Record-ID")
    for h in (meta, conv):
        assert w.header(h, "WARC-Refers-To") == source and w.header(h, "WARC-Date") == "2020-01-02T03:04:05Z"
        assert w.header(h, "WARC-Target-URI") == "http://a.example/x/y?z=1"
    about = json.loads(envelope)
    assert about["conversion"] == w.header(conv, "WARC-Record-ID") != w.header(meta, "WARC-Record-ID")
    assert [tuple(h) for h in about["source"]["headers"]] == headers and about["source"]["block-digest-holds"] and about["source"]["payload-digest-holds"]
    assert text == b"t\nx\ny" and w.header(conv, "WARC-Block-Digest") == w.digest(text) and about["html"]["title"] == "t"


def test_tables(spark):
    raw = response() + w.write_record([("WARC-Type", "request")], b"GET /") + response(page="<p>two")
    files = [("a", raw), ("b", gzip.compress(raw)), ("c", None), ("d", b"junk"), ("e", raw[:-30]), (None, raw), ("f", b"")]
    found = w.records(spark.createDataFrame([(*f, "clash") for f in files], "path string, content binary, error string"))
    rows = found.collect()
    by = {s: [r for r in rows if r.source == s] for s, _ in files}
    assert [len(by[s]) for s, _ in files] == [3, 3, 0, 1, 3, 3, 0] and by["d"][0].error and by["e"][-1].error
    made = w.derivatives(found)
    assert made.count() == 2 * (2 + 2 + 1 + 2)
    back = w.records(w.as_files(made), "source", "content").collect()
    assert sorted((r.type, r.record_id, bytes(r.block)) for r in back) == sorted((r.type, r.record_id, bytes(r.block)) for r in made.collect())
    assert w.derivatives(w.records(spark.createDataFrame([], "path string, content binary"))).count() == 0


def test_query(spark, tmp_path):
    pages = [(1, "http://x.example/a", "<h1>A</h1><p>b &amp; c"), (2, None, None), (3, "", ""), (1, "http://x.example/a", "<h1>A</h1><p>b &amp; c"), (None, "u", "<p>\ud83d" if False else "<p>z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = w.op9_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(pages)
    ids = {(r.page_id, r.type): r for r in rows}
    assert ids[1, "metadata"].conversion_id == ids[1, "conversion"].record_id and ids[1, "metadata"].refers_to == ids[1, "conversion"].refers_to
    assert ids[1, "conversion"].block_digest == w.digest(b"A\nb & c") and ids[2, "conversion"].block_bytes == 0


def test_very_long_pages_and_clashing_columns(spark, tmp_path):
    page = "<p>" + "word &amp; " * 400_000
    rows = [(1, "http://x.example/", page, "clash"), (2, "u", None, "clash")]
    spark.createDataFrame(rows, "page_id long, url string, html string, type string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.type): r for r in w.op9_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got[1, "conversion"].block_bytes == len("word & " * 400_000) - 1
