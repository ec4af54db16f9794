import gzip
import hashlib

from llm import warc


def test_arc_versions_and_declared_lengths():
    payload = b"<p>a\n\n</p>" * 20
    for version in (1, 2):
        data = warc.arc_version_block(version, "f.arc") + warc.arc_record(version, "f.arc", 0, "http://x/a b", "20010203040506", 7, payload) + warc.arc_record(
            version, "f.arc", 9, None, "2001", None, b"")
        one, two = warc.arc_records(data)
        assert (one["url"], one["date"], one["page_id"], one["payload"], one["problem"]) == ("http://x/a%20b", "20010203040506", 7, payload, None)
        assert one["payload_digest"] == hashlib.sha256(payload).hexdigest() and two["page_id"] is None and two["payload_bytes"] == 0
        assert [r.get("problem") for r in warc.arc_records(data[:-20])][-1] == "damaged record"
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_pages_through_archives(spark, frame):
    big, small = "é" * 60, "s" * 99
    rows = [(3, "u", big, 1, "r"), (1, None, big, 1, "r"), (2, "a b\nc", small, 1, "r"), (4, "u", small, 1, "r"), (5, "u", None, 1, "r"), (6, "u", "", 1, "r"),
            (7, "u", big, 1, "r"), (7, "u", big, 1, "r"), (None, "u", big, 1, "r"), (8, "u", "x" * 9_000_000, 1, "r"), (9, "u", "\r\n\r\nWARC/1.0", 1, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, record_type string")
    got = warc.through_archives(pages).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    of = {r.page_id: r for r in got}
    assert {k: (r.record_type, r.refers_to) for k, r in of.items()} == {
        1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), None: ("response", None), 8: ("response", None), 9: ("response", None)}
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        assert (of[page_id].payload_bytes, of[page_id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_payloads_come_back_and_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://u", "<p>ä</p>")], "page_id long, url string, html string")
    parts = warc.convert(warc.write_arc(pages))
    for n, r in enumerate(parts.collect()):
        (tmp_path / f"{n}.warc.gz").write_bytes(r.content)
        (tmp_path / f"{n}.warc").write_bytes(gzip.decompress(r.content))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = warc.read_warc(files).where("record_type = 'response'").collect()
    assert [bytes(r.payload).decode() for r in found] == ["<p>ä</p>"] * 2 and len({r.record_id for r in found}) == 1


def test_foreign_archives_keep_every_record(spark, tmp_path):
    def record(url, payload, length, date="20010203040506"):
        head = f"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Length: {length}\r\n\r\n".encode()
        return f"{url} 1.2.3.4 {date} text/html {len(head) + len(payload)}\n".encode() + head + payload + b"\n"

    same, cut, odd = b"s" * 200, b"c" * 150, b"o" * 160
    data = warc.arc_version_block(1, "f.arc") + b"".join([
        record("http://a", same, 200), record("http://b", same, 200), record("http://c", cut, 900), record("http://d", odd, "many"),
        record("http://a", same, 200), record("http://e", b"t" * 120, 120)])
    end = b"http://f 1.2.3.4 20010203040506 text/html 5000\nHTTP/1.1 200 OK\r\n\r\nshort"
    (tmp_path / "f.arc").write_bytes(data + end)
    found = warc.read_warc(warc.convert(spark.read.format("binaryFile").load(str(tmp_path)))).where("record_type <> 'warcinfo'").collect()
    assert len(found) == 7
    of = {r.url: r for r in found}
    a, b = of["http://a"], of["http://b"]
    assert sorted((a.record_type, b.record_type)) == ["response", "revisit"]  # the two records of a are one capture
    revisit, response = (a, b) if a.record_type == "revisit" else (b, a)
    assert revisit.refers_to_record == response.record_id and revisit.payload_bytes == 200 and bytes(response.payload) == same
    assert (of["http://c"].record_type, of["http://c"].problem, bytes(of["http://c"].payload)) == ("response", "payload of another length", cut)
    assert (of["http://d"].record_type, of["http://d"].problem, bytes(of["http://d"].payload)) == ("response", "content length is no number", odd)
    assert (of["http://e"].record_type, of["http://e"].problem) == ("response", None)
    assert (of["http://f"].record_type, of["http://f"].problem, bytes(of["http://f"].payload)) == ("metadata", "damaged record", end)
