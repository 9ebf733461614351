"""Resolution of WARC not-modified revisits.

A revisit record with the server-not-modified profile holds a 304 answer: the
content is that of an earlier capture. Each revisit is joined as of its date
with the latest earlier full response of the same canonical URL (of equal dates,
the smaller record id counts as earlier). A full response is one with status 200
and all of its payload; records without a status count as full. Its validators are checked against the
response's, and the response's headers are updated by those that a 304 may
change (RFC 9111, 3.2: not those of the content's length, type, coding or range,
nor hop-by-hop ones).

The as-of join never gathers one URL's captures in a task: dates are cut at
quantiles into ``SLICES`` ranges of like numbers of records, so that a few odd
dates don't put all others into one; the latest response within (URL, range)
comes from a window over that part only, and what earlier ranges leave comes
from one summary row for each. Headers and payloads are joined by record id afterwards, where AQE
splits a response that very many revisits refer to.

Edge cases: null or unparsable URLs are one key of their own, as written, and a
null URL or date is never resolved (``orphan``); null headers count as none;
a revisit without a validator resolves as ``unchecked``; repeated rows are
resolved each; an empty table gives an empty one; the result has a fixed set of
columns, so others in the input cannot clash.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 64
#: Ranges that are told apart first, then those within one.
_STEP = 8
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: WARC 1.0 and 1.1 name the profile with URIs that end alike.
NOT_MODIFIED_END = "/revisit/server-not-modified"
#: Headers that a 304 answer must not change.
FIXED_HEADERS = (
    "content-length", "content-type", "content-encoding", "content-range", "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)

RECORDS = "record_id long, url string, kind string, profile string, date timestamp, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Key of a URL: no scheme, ``www.``, default port of the scheme, fragment, tracking parameters or closing slash; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    secure = F.lower(bare).startswith("https:")
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.when(secure, F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid)(=|$)"))), "&")
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ by case only, the first in byte order counts."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    firsts = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda p: p["key"]), e["key"]) == i + 1)
    return F.map_from_entries(firsts)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers (lower-case names) with what the 304 answer may change."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*FIXED_HEADERS))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame, *, slices: int = SLICES) -> DataFrame:
    """For each revisit: ``record_id, url_key, refers_to, status, headers, payload``.

    Status: ``resolved`` (a validator agrees), ``unchecked`` (the revisit has none),
    ``mismatch`` (it disagrees; nothing is merged) or ``orphan`` (no earlier response).
    ``records`` has the columns of ``RECORDS`` and may have ``http_status``; kinds other than
    response and revisit, and responses that are not full, are left out.
    """
    answered = records.where(F.col("kind").isin("response", "revisit"))
    if "http_status" in records.columns:
        answered = answered.where((F.col("kind") == "revisit") | F.coalesce(F.expr("try_cast(http_status AS int)") == 200, F.lit(True)))
    keyed = answered.select("record_id", canonical_url(F.col("url")).alias("url_key"), (F.col("kind") == "response").alias("full"), F.unix_micros("date").alias("at"), _lower_keys(F.col("headers")).alias("headers"), "profile", "payload")
    full = F.col("full")
    usable = keyed.where(full | F.coalesce(F.col("profile").endswith(NOT_MODIFIED_END), F.lit(True)))
    slim = usable.select("record_id", "url_key", "full", "at")
    known = slim.where("url_key IS NOT NULL AND at IS NOT NULL")
    cuts = F.percentile_approx("at", [k / slices for k in range(1, slices)], F.lit(10_000))
    ends = known.agg(cuts.alias("cuts"))  # one row, broadcast by its nature
    ends = ends.select("cuts", F.filter("cuts", lambda _, i: i % _STEP == _STEP - 1).alias("steps"))
    upto = lambda c: F.size(F.filter(c, lambda b: b <= F.col("at")))
    coarse = upto(F.col("steps")) * _STEP
    stepped = known.join(F.broadcast(ends), how="inner").withColumn("coarse", coarse)
    sliced = stepped.withColumn("part", F.col("coarse") + upto(F.slice("cuts", F.col("coarse") + 1, F.lit(_STEP)))).drop("cuts", "steps", "coarse")
    along = Window.partitionBy("url_key", "part").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("near", F.last(F.when(full, F.col("record_id")), ignorenulls=True).over(along)).where(~full)
    tops = sliced.where(full).groupBy("url_key", "part").agg(F.max_by("record_id", F.struct("at", "record_id")).alias("top"))
    wanted = within.where("near IS NULL").select("url_key", "part").distinct()
    every = tops.select("url_key", "part", "top").unionByName(wanted.withColumn("top", F.lit(None).cast("long"))).groupBy("url_key", "part").agg(F.max("top").alias("top"))
    carried = every.select("url_key", "part", F.last("top", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = within.join(carried, ["url_key", "part"], "left").select("record_id", F.coalesce("near", "before").alias("refers_to"))
    revisits = usable.where(~full).select("record_id", "url_key", F.col("headers").alias("update"))
    linked = revisits.join(found.groupBy("record_id").agg(F.max("refers_to").alias("refers_to")), "record_id", "left")
    stored = usable.where(full).select(F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), F.col("payload"))
    both = linked.join(stored, "refers_to", "left")
    tag, seen = F.col("update")["etag"], F.col("stored")["etag"]
    changed, stamp = F.col("update")["last-modified"], F.col("stored")["last-modified"]
    status = (
        F.when(F.col("refers_to").isNull(), "orphan")
        .when(tag.isNotNull(), F.when(_weak(tag) == _weak(seen), "resolved").otherwise("mismatch"))
        .when(changed.isNotNull(), F.when(changed == stamp, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    holds = F.col("status").isin("resolved", "unchecked")
    return both.withColumn("status", status).select("record_id", "url_key", "refers_to", "status", F.when(holds, merged_headers(F.col("stored"), F.col("update"))).alias("headers"), F.when(holds, F.col("payload")).alias("payload"))


def parse(data: bytes | IO[bytes]) -> Iterator[dict[str, Any]]:
    """Records of a WARC file (plain or gzip members), one at a time, as rows of ``RECORDS`` and ``http_status``; the id is the order.

    A record that says it is truncated has the status of partial content, 206. A file that
    breaks off gives the records before that place; lines that are no header are passed over.
    """
    stream = io.BufferedReader(io.BytesIO(data)) if isinstance(data, bytes) else data
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    number = 0
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = fields.get("content-length", "0")
            size = int(size) if size.isascii() and size.isdigit() else 0
            body = stream.read(size)
            if len(body) < size:
                return
            head, _, payload = body.partition(b"\r\n\r\n")
            lines = head.decode("latin-1").split("\r\n")
            headers: dict[str, str] = {}
            http = fields.get("warc-type") in ("response", "revisit") and lines[0].startswith("HTTP/")
            status = None
            if http:
                code = (lines[0].split(" ") + [""])[1]
                status = 206 if "warc-truncated" in fields else int(code) if code.isascii() and code.isdigit() else None
                for item in lines[1:]:
                    name, _, value = item.partition(":")
                    headers.setdefault(name.strip().lower(), value.strip())
            yield {
                "record_id": number,
                "url": fields.get("warc-target-uri"),
                "kind": fields.get("warc-type"),
                "profile": fields.get("warc-profile"),
                "date": fields.get("warc-date"),
                "headers": headers,
                "payload": payload if http else body,
                "http_status": status,
            }
            number += 1
    except EOFError:
        return


#: Bytes of payload, and records, that go to Spark at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_000


def opened(name: str) -> IO[bytes]:
    """A file to read from, by the path that Spark lists it under."""
    from pyarrow import fs

    if name.startswith("file:"):
        return open("/" + name.removeprefix("file:").lstrip("/"), "rb")
    system, path = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
    return io.BufferedReader(system.open_input_file(path))


_KINDS = {"file": pa.string(), "number": pa.int64(), "url": pa.string(), "kind": pa.string(), "profile": pa.string(), "stamp": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "http_status": pa.int32()}


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Records of all WARC files under a path; a record's id is a hash of its file and place.

    Workers read files record by record, so a file may be of any size and memory follows
    single records; files are spread over tasks by their sizes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))

        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, size = [], 0
                with opened(name) as stream:
                    for r in parse(stream):
                        found.append((name, r["record_id"], r["url"], r["kind"], r["profile"], r["date"], list(r["headers"].items()), r["payload"], r["http_status"]))
                        size += len(r["payload"])
                        if size >= BATCH_BYTES or len(found) >= BATCH_ROWS:
                            yield made(found)
                            found, size = [], 0
                if found:
                    yield made(found)

    # Only names are taken from the listing; contents stay where they are.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    raw = files.mapInArrow(rows, "file string, number long, url string, kind string, profile string, stamp string, headers map<string,string>, payload binary, http_status int")
    return raw.select(F.xxhash64("file", "number").alias("record_id"), "url", "kind", "profile", F.to_timestamp("stamp").alias("date"), "headers", "payload", "http_status")
