"""WARC archives of captured pages and their merged index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adsight.plans.session import scratch
from adsight.plans.stages import staged

RANGE_ROWS = 100_000    # captures that one merge task holds
# Fixed values of the WARC format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a payload."""
    quarters = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0")
                for i in range(4)]
    return F.translate(F.concat(*quarters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One WARC record (column ``value``) per page, without the blank lines that end it.

    Of equal payloads of at least ``min_revisit_bytes`` the smallest id is the response; others are
    revisits that carry the HTTP head and refer to it. Rows that share the smallest id (repeated
    rows) are all responses; null ids come last. Null payloads and urls count as empty. The time
    of a capture is its id in seconds after 2020, as the table has none. Digests are counted
    without payloads; the payload moves once, in a join that adaptive execution can split.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias(
        "url"), payload.alias("payload"), payload_digest(payload).alias("digest"),
        F.octet_length(payload).alias("size"))
    shared = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(shared, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                         "Content-Length: "])), F.col("size").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    stamp = F.date_format(F.timestamp_seconds(
        F.lit(1577836800) + F.coalesce(F.col("id").cast("bigint"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    named = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        named("WARC-Type", F.when(again, "revisit").otherwise("response")),
        named("WARC-Record-ID", urn(F.col("id"))),
        named("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]", "%20")),
        named("WARC-Date", stamp),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(named("WARC-Refers-To", urn(F.col("first"))),
                               named("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        named("Content-Type", F.lit("application/http; msgtype=response")),
        named("Content-Length", length.cast("string")), F.lit(CRLF * 2), http)
    body = F.when(again, "").otherwise(F.col("payload").cast("string"))
    return joined.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Writes the pages as gzip-compressed WARC files, one for each task of the last join."""
    records(pages, **options).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host names reversed, no scheme, port 80/443 or leading www."""
    parts = urlsplit(url if "://" in url else f"http://{url}")
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    names = host.removeprefix("www.").split(".")[::-1]
    tail = parts.path or "/"
    return ",".join(names) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (
        tail.lower() + (f"?{parts.query}" if parts.query else ""))


def parse_archive(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset in the unpacked file, header fields in lower case, block) of every record."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        while True:
            offset = stream.tell()
            line = stream.readline()
            if not line:
                return
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {offset}")
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
            block = stream.read(int(fields["content-length"]))
            if len(block) < int(fields["content-length"]):
                raise ValueError(f"cut WARC record at {offset}")
            yield offset, fields, block


def _capture(offset: int, fields: dict, block: bytes) -> tuple:
    """Index entry of a record; a response's digest and size are those of its bytes."""
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    number = lambda urn: int(urn) if (urn := urn.removeprefix("<urn:page:").rstrip(">")) else None
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if revisit:
        size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n")
                    if line.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    try:
        key = url_key(fields["warc-target-uri"])
    except ValueError:  # a host in broken brackets
        key = fields["warc-target-uri"].lower()
    return (key, fields["warc-date"], number(fields["warc-record-id"]), offset, fields["warc-type"],
            size, digest, number(fields["warc-refers-to"]) if revisit else None)


RUN = ("url_key string, captured_at string, page_id bigint, offset bigint, record_type string, "
       "payload_bytes bigint, payload_digest string, refers_to bigint, file string, seq int")


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[3]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, each file a locally sorted run numbered by ``seq``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        "path", "content")

    def scan(batches):
        names = [f.split()[0] for f in RUN.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                run = sorted((_capture(*r) for r in parse_archive(content.as_py())), key=_order)
                columns = list(zip(*run)) if run else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (
                        pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                        pa.string(), pa.int64()))] + [
                        pa.array([path.as_py()] * len(run), pa.string()),
                        pa.array(range(len(run)), pa.int32())], names=names)

    return files.mapInArrow(scan, RUN)


class LoserTree:
    """k-way merge: inner nodes keep the loser of a match, so a step replays one leaf's path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * len(runs)
        self.winner = -1
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return b >= 0 and a < 0     # an empty seat wins until every leaf has been entered
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, leaf: int) -> None:
        node = (leaf + len(self.runs)) // 2
        while node:
            if self._beats(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node //= 2
        self.winner = leaf

    def __iter__(self):
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of (url_key, captured_at, page_id, file, offset).

    Ranges of that whole key are dealt to tasks, so a url with a third of all captures is split
    over several, and each task merges the slices that the runs have in its range. A range holds
    about ``RANGE_ROWS`` entries. Partition numbers and row order give the global order.
    """
    runs = staged(runs, "runs")
    parts = runs.count() // RANGE_ROWS + 1
    unknown = F.col("page_id").isNull()
    dealt = runs.withColumn("unknown", unknown).repartitionByRange(
        parts, "url_key", "captured_at", "unknown", "page_id", "file", "offset").drop(
        "unknown").sortWithinPartitions("file", "seq")

    def merge(batches):
        slices = [b for b in batches if b.num_rows]
        if not slices:
            return
        rows = pa.Table.from_batches(slices).combine_chunks()
        keys = list(zip(*(rows.column(c).to_pylist() for c in (
            "url_key", "captured_at", "page_id", "file", "offset"))))
        keys = [(u, t, p is None, p or 0, f, o) for u, t, p, f, o in keys]
        starts = [i for i in range(len(keys)) if not i or keys[i][4] != keys[i - 1][4]]
        ends = starts[1:] + [len(keys)]
        tree = LoserTree([((keys[i], i) for i in range(a, b)).__iter__()
                          for a, b in zip(starts, ends)])
        order = pa.array([i for _, i in tree], pa.int64())
        yield from rows.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, RUN)


def capture_histories(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages as archives, reads them back and returns the merged capture index."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path, **options)
    return merge_runs(capture_runs(spark, path))
