"""WARC archives and their capture index.

``write_archives`` writes one WARC/1.1 record for each page through Spark's text writer (its line separator is the two
line ends that close a record), so archives land in any store that Spark writes to, under its commit protocol. Equal
payloads are stored once: the record of the largest page_id is the response, the others revisit it. The largest payload
bounds the records of a file, so that no archive exceeds ``ARCHIVE`` bytes (but for one that a single record exceeds).

``read_archives`` parses archives record by record, checks stored payloads against their digests, and emits each archive's
captures as one locally sorted run. ``merged_index`` merges the runs outside of memory: runs are cut into segments of
``SEGMENT`` captures and at the borders of ranges of (URL key, timestamp, page); Spark brings the segments of a range
together and sorts them, not the captures, by the first capture of each; a loser tree merges the runs while segments
are read in that order, so that a run's next segment is read just when it can be needed and each run has one in memory.
(range, rank) orders all captures.

A null html is empty; null urls have an empty key; null page_ids are kept and never are the largest unless alone; rows
that repeat the largest page_id of a payload are all responses. Empty input gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_right
from itertools import chain, groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialize, read, scratch_dir

ARCHIVE = 512 << 20  # bytes of an archive before compression, at most
SEGMENT = 1000  # captures of a run that travel together
SAMPLE = 64  # captures for each range that its borders are chosen from
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_CAPTURE = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, place long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}{'?' + parts.query.lower() if parts.query else ''}"


def _records(batches):
    for batch in batches:
        out = []
        for page, url, html, first, date in zip(*(batch.column(i).to_pylist() for i in range(5))):
            payload = (html or "").encode()
            revisit = first is not None and page != first
            name = "" if page is None else page
            head = [
                "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
                *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
                f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
            ]
            body = _HTTP.format(len(payload))
            size = len(body)
            if revisit:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
            else:
                body, size = body + (html or ""), size + len(payload)
            out.append("\r\n".join([*head, f"Content-Length: {size}", "", body]))
        yield pa.record_batch([pa.array(out, pa.large_string() if batch.schema.field(2).type == pa.large_string() else pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """pages (page_id, url, html[, date]) to gzipped WARC files under ``path``; payloads of at least ``least`` bytes are stored once."""
    date = F.col("date") if "date" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select("page_id", "url", "html", date.alias("date"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    copies = rows.filter(large).groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    named = rows.join(copies, "sha", "left").select("page_id", "url", "html", "first", "date")
    longest = pages.agg(F.max(F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)))).head()[0] or 0
    per_file = max(1, ARCHIVE // (longest + 1024))  # headers take less than a kilobyte
    named.mapInArrow(_records, "value string").write.option("maxRecordsPerFile", per_file).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(stream):
    """(headers, block, place) of each record of a WARC stream."""
    place = 0
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {place}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            head[name.strip()] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        end = stream.read(4)
        if len(block) != int(head["Content-Length"]) or end != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {place}")
        yield head, block, place
        place += size + len(line) + len(block) + 4


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def _captures(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = []
            for head, block, place in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                digest, size, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), None
                if head["WARC-Type"] == "revisit":
                    refers = _page(head["WARC-Refers-To"])
                else:
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (_digest(payload), len(payload)) != (digest, size):
                        raise ValueError(f"payload differs from its digest in {path} at byte {place}")
                run.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, path, place))
            run.sort(key=_key)
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in run], t) for i, t in enumerate(types)], [f.split()[0] for f in _CAPTURE.split(", ")])


def _key(capture: tuple) -> tuple:
    return capture[0].encode(), capture[1], (capture[2] is not None, capture[2] or 0), capture[7], capture[8]


def read_archives(spark, path: str) -> DataFrame:
    """The captures of all archives under ``path``; those of one archive (``run``) in order of URL key, timestamp and page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_captures, _CAPTURE)


def _tournament(heads: list) -> tuple[list[int], int]:
    """(losers of the inner nodes 1 .. k - 1, winner) over k runs; a run without a head loses to all others."""
    k = len(heads)
    tree, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if _beats(heads, a, b) else (b, a)
    return tree, winner[1]


def _beats(heads: list, a: int, b: int) -> bool:
    return heads[b] is None or heads[a] is not None and (heads[a], a) < (heads[b], b)


def merge_runs(segments):
    """All captures in order. segments: (run, captures in order), at least one capture each, sorted by their first ones; those of one run
    don't overlap.

    A tree of losers picks the next capture from the segments read so far as long as it comes before the first capture of the next
    segment; then that is read. So a run's segments are in memory one after the other.
    """
    source = iter(segments)
    pending, runs, waiting, heads = next(source, None), {}, [], []
    while pending is not None:
        run, captures = pending
        if run not in runs:
            runs[run] = len(heads)
            heads.append(None)
            waiting.append(iter(()))
        i = runs[run]
        if heads[i] is None:
            waiting[i] = iter(captures)
            heads[i] = _head(waiting[i])
        else:  # its own last capture is still to come
            waiting[i] = chain(waiting[i], captures)
        pending = next(source, None)
        border = None if pending is None else _key(pending[1][0])
        tree, best = _tournament(heads)
        while heads[best] is not None and (border is None or heads[best][0] < border):
            yield heads[best][1]
            heads[best] = _head(waiting[best])
            node = (best + len(heads)) // 2
            while node:
                if _beats(heads, tree[node], best):
                    tree[node], best = best, tree[node]
                node //= 2


def _head(captures):
    """(key, capture) of the next capture."""
    c = next(captures, None)
    return None if c is None else (_key(c), c)


def _segments(borders: list[tuple]):
    """Arrow function: captures, those of a run in order, to segments (range, run, captures)."""

    def run(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            cuts, ranges = [], []
            for i, row in enumerate(rows):
                r = bisect_right(borders, _key(row))
                if not cuts or row[7] != rows[i - 1][7] or r != ranges[-1] or i - cuts[-1] >= SEGMENT:
                    cuts.append(i)
                    ranges.append(r)
            if cuts:
                every = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
                firsts = pa.array(cuts, pa.int64())
                yield pa.record_batch([pa.array(ranges, pa.int64()), batch.column(7).take(firsts), pa.ListArray.from_arrays(pa.array([*cuts, len(rows)], pa.int32()), every)], ["range", "run", "captures"])

    return run


def _merge(batches):
    """Arrow function: segments sorted by range and first capture to captures with their range and rank in it."""
    names = [f.split()[0] for f in _CAPTURE.split(", ")]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def read():
        for batch in batches:
            for r, run, captures in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield r, run, [tuple(c.values()) for c in captures.as_py()]

    def packed(out):
        return pa.record_batch([*(pa.array([o[2][i] for o in out], t) for i, t in enumerate(types)), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], [*names, "range", "rank"])

    out = []
    for r, segments in groupby(read(), key=lambda x: x[0]):
        for n, capture in enumerate(merge_runs((run, captures) for _, run, captures in segments)):
            out.append((r, n, capture))
            if len(out) == 10_000:
                yield packed(out)
                out = []
    if out:
        yield packed(out)


def merged_index(captures: DataFrame, ranges: int) -> DataFrame:
    """captures with range and rank: capture histories in global order of (range, rank). captures: stored, those of a run in order."""
    key = ["urlkey", "timestamp", "page_id", "run", "place"]
    chosen = captures.select(*captures.columns).orderBy(F.xxhash64(*key), *key).limit(ranges * SAMPLE).collect()
    borders = sorted(_key(tuple(c)) for c in chosen)
    borders = borders[SAMPLE // 2 :: SAMPLE][: ranges - 1]
    cut = captures.mapInArrow(_segments(borders), f"range long, run string, captures array<struct<{_CAPTURE.replace(' ', ': ')}>>".replace(",: ", ", "))
    first = F.col("captures")[0]
    dealt = cut.repartition(ranges, "range").sortWithinPartitions("range", *[first[k] for k in key])
    return dealt.mapInArrow(_merge, f"{_CAPTURE}, range long, rank long")


def op4_warc_index(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    index = merged_index(materialize(read_archives(spark, path), "captures"), buckets_for(spark))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
g AS (SELECT h, max(page_id) m FROM p GROUP BY h),
b AS (SELECT p.page_id, strlen(p.h) n, g.m, CAST(CAST(unhex(sha1(p.h)) AS BIT) AS VARCHAR) bits FROM p JOIN g ON p.h = g.h)
SELECT page_id, CAST(n AS BIGINT) payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER) AS BIGINT), 1)), '') payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> m THEN m END refers_to
FROM b
"""
