import datetime
import gzip
import random

from loomgraph.llm import warc

DAY = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, warc.RECORDS)


def test_as_of_join_against_search(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        full = rnd.random() < 0.4
        url = "http://hot.example/" if rnd.random() < 0.4 else f"https://www.Site{rnd.randrange(20)}.example:443/a/?b=2&a=1&utm_source=x#f"
        tag = rnd.choice(["1", "2", None])
        rows.append((i, url, "response" if full else "revisit", None if full else warc.NOT_MODIFIED, DAY + datetime.timedelta(seconds=rnd.randrange(200)), {"ETag": tag, "Date": str(i)} if tag else {"Date": str(i)}, bytearray(b"p%d" % i) if full else None))
    got = {r["record_id"]: r for r in warc.resolve(frame(spark, rows), slices=7).collect()}
    host = lambda u: u.split("/")[2].lower()
    for i, url, kind, _, date, headers, _ in rows:
        if kind == "response":
            assert i not in got
            continue
        earlier = [(d, j, h, p) for j, u, k, _, d, h, p in rows if k == "response" and host(u) == host(url) and (d, j) < (date, i)]
        r = got[i]
        if not earlier:
            assert r["status"] == "orphan" and r["refers_to"] is None and r["headers"] is None
            continue
        _, j, stored, payload = max(earlier, key=lambda e: e[:2])
        tag = headers.get("ETag")
        status = "unchecked" if tag is None else "resolved" if tag == stored.get("ETag") else "mismatch"
        assert (r["refers_to"], r["status"]) == (j, status)
        if status == "mismatch":
            assert r["payload"] is None and r["headers"] is None
        else:
            assert bytes(r["payload"]) == bytes(payload)
            assert r["headers"] == {k.lower(): v for k, v in {**stored, **headers}.items()}


def test_only_permitted_headers_change(spark):
    rows = [
        (1, "http://a.example/x", "response", None, DAY, {"Content-Type": "text/html", "content-length": "5", "ETag": 'W/"q"', "X-Old": "1", "x-old": "2"}, bytearray(b"hello")),
        (2, "HTTP://A.example:80/x/", "revisit", warc.NOT_MODIFIED, DAY + datetime.timedelta(1), {"Content-Length": "0", "Content-Type": "text/plain", "Connection": "close", "etag": '"q"', "Expires": "later"}, None),
        (3, "http://a.example/x", "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", DAY + datetime.timedelta(2), {}, None),
        (4, "http://a.example/x", "request", None, DAY, {}, None),
        (5, None, "revisit", warc.NOT_MODIFIED, DAY, None, None),
        (6, "http://a.example/x", "revisit", None, None, {"Last-Modified": "never"}, None),
        (7, "http://a.example/x", "revisit", None, DAY + datetime.timedelta(3), {"Last-Modified": "never"}, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve(frame(spark, rows)).collect()}
    assert set(got) == {2, 5, 6, 7}
    assert got[2]["headers"] == {"content-type": "text/html", "content-length": "5", "etag": '"q"', "x-old": "1", "expires": "later"}
    assert bytes(got[2]["payload"]) == b"hello" and got[2]["url_key"] == "a.example/x"
    assert [got[k]["status"] for k in (5, 6, 7)] == ["orphan", "orphan", "mismatch"]


def test_repeats_clashes_and_empty(spark):
    rows = [(1, "not a url", "response", None, DAY, None, bytearray(b"x")), (2, "not a url", "revisit", None, DAY + datetime.timedelta(1), None, None), (2, "not a url", "revisit", None, DAY + datetime.timedelta(1), None, None)]
    df = frame(spark, rows)
    for name in ("status", "refers_to", "part", "at", "stored"):
        df = df.selectExpr("*", f"'z' AS {name}")
    got = warc.resolve(df).collect()
    assert len(got) == 2 and all(r["refers_to"] == 1 and r["status"] == "unchecked" and r["headers"] == {} for r in got)
    assert warc.resolve(df.limit(0)).count() == 0


def test_files_are_read(spark, tmp_path):
    def record(kind, url, date, http, body, profile=""):
        block = http.encode() + b"\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{profile}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    one = record("response", "http://a.example/", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "1"', b"first\r\n\r\nbody")
    two = record("revisit", "http://a.example/", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "1"', b"", f"WARC-Profile: {warc.NOT_MODIFIED}\r\n")
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one.replace(b"a.example", b"b.example")))
    records = warc.read(spark, str(tmp_path))
    assert records.count() == 4 and records.select("record_id").distinct().count() == 4
    got = warc.resolve(records).collect()
    assert [(r["status"], bytes(r["payload"])) for r in got] == [("resolved", b"first\r\n\r\nbody")] * 2


def test_profile_of_warc_1_0_counts(spark, tmp_path):
    def record(kind, date, http, body, profile=""):
        block = http.encode() + b"\r\n\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: {date}\r\n{profile}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    named = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/"
    early = record("revisit", "2023-12-31T00:00:00Z", "HTTP/1.1 304 Not Modified", b"", f"{named}server-not-modified\r\n")
    one = record("response", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "1"', b"body")
    two = record("revisit", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "1"', b"", f"{named}server-not-modified\r\n")
    other = record("revisit", "2024-01-03T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "1"', b"", f"{named}identical-payload-digest\r\n")
    (tmp_path / "x.warc").write_bytes(early + one + two + other)
    got = warc.resolve(warc.read(spark, str(tmp_path))).collect()
    assert sorted((r["status"], r["payload"] and bytes(r["payload"])) for r in got) == [("orphan", None), ("resolved", b"body")]


def test_only_full_responses_count(spark, tmp_path):
    """A 404, a partial and a truncated answer between the full one and the revisit are passed over; a last record that breaks off is left out."""

    def record(kind, date, http, body, more=""):
        block = http.encode() + b"\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: https://a.example:443/p?ref=1\r\nWARC-Date: {date}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    parts = [
        record("response", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", b"full"),
        record("response", "2024-01-02T00:00:00Z", "HTTP/1.1 404 Not Found", b"none"),
        record("response", "2024-01-02T01:00:00Z", "HTTP/1.1 206 Partial Content", b"part"),
        record("response", "2024-01-02T02:00:00Z", "HTTP/1.1 200 OK", b"cut", "WARC-Truncated: length\r\n"),
        record("revisit", "2024-01-03T00:00:00Z", "HTTP/1.1 304 Not Modified", b"", f"WARC-Profile: {warc.NOT_MODIFIED}\r\n"),
        record("response", "2024-01-02T03:00:00Z", "HTTP/1.1 200 OK", b"x" * 500)[:-300],
    ]
    (tmp_path / "x y.warc").write_bytes(b"".join(parts))
    (tmp_path / "z.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:5])[:-60])
    records = warc.read(spark, str(tmp_path))
    assert sorted(r["http_status"] for r in records.collect()) == [200, 200, 206, 206, 206, 206, 304, 404, 404]
    got = warc.resolve(records).collect()
    assert [(r["status"], bytes(r["payload"]), r["url_key"]) for r in got] == [("unchecked", b"full", "a.example/p?ref=1")]


def test_many_records_and_a_long_payload_are_read_in_batches(spark, tmp_path):
    block = lambda n: b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * n
    head = lambda i, n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.example/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {n + 19}\r\n\r\n".encode()
    sizes = [10] * 2500 + [30_000_000] + [20] * 3
    (tmp_path / "x.warc").write_bytes(b"".join(head(i, n) + block(n) + b"\r\n\r\n" for i, n in enumerate(sizes)))
    found = warc.read(spark, str(tmp_path)).selectExpr("octet_length(payload) AS n").groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in found} == {10: 2500, 30_000_000: 1, 20: 3}


def test_odd_dates_do_not_crowd_the_ranges(spark):
    """One record of 1970 and one of 9999 among a hot URL's captures leave the others spread over the ranges."""
    rows = [(i, "http://hot.example/", "response" if i % 3 else "revisit", None, DAY + datetime.timedelta(seconds=i), {}, bytearray(b"%d" % i) if i % 3 else None) for i in range(1, 400)]
    rows += [(1000, "http://hot.example/", "response", None, datetime.datetime(1970, 1, 2), {}, bytearray(b"old")), (1001, "http://hot.example/", "revisit", None, datetime.datetime(9999, 1, 1), {}, None)]
    got = {r["record_id"]: r["refers_to"] for r in warc.resolve(frame(spark, rows)).collect()}
    assert got == {i: i - 1 for i in range(6, 400, 3)} | {3: 2, 1001: 398}
