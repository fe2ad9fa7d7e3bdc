"""WARC archives with revisit records, and their index by external merge of sorted runs (operator 1)."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, parts_for, text_of

PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("archive", pa.string()), ("position", pa.int64()), ("length", pa.int64())])
INDEX_SQL = ("url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, "
             "payload_digest string, refers_to long, archive string, position long, length long")


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
                   captured: Column | None = None, least: int = 1000, archive_bytes: int = 32 << 20) -> None:
    """Write a WARC 1.1 record per row of `pages` to gzip files of about `archive_bytes` (unpacked) in `folder`.

    Of the rows with equal payloads of at least `least` bytes, that with the largest id gets a response record (and
    rows that repeat it, id and payload alike); the others get revisit records that refer to it. Null html is an empty
    payload; a null id is written as none; line ends in a URL are escaped; a null URL has no header. Records are
    UTF-8 text and end in two line ends, so Spark's text writer makes the files, with its commit protocol: a
    lost executor or a second try leaves no half-written archive. `captured` (default: a time made from the id)
    is the time of capture.
    """
    spark = pages.sparkSession
    digest, size = F.sha1(text_of(html)), F.octet_length(text_of(html)).cast("long")
    light = Scratch(spark, "payloads").keep(pages.select(
        F.col(id).cast("long").alias("id"), digest.alias("digest"), size.alias("size")), "digests")
    large = light.filter(F.col("size") >= least)
    # digests in use more than once; written, so that the join below has two plain shuffles and can split a hot one
    copied = Scratch(spark, "copies").keep(
        large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    fate = (large.join(copied, "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
            .select(F.coalesce("id", F.lit(-1 << 63)).alias("fate_id"), F.col("digest").alias("fate_digest"), "first")
            .distinct())
    total, n = light.agg(F.sum(F.col("size") + 600), F.count("*")).first()
    per_file = max(1, archive_bytes * n // max(1, total or 0))  # rows fall to files by hash, so files are of like size
    if captured is None:
        captured = F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(F.col(id), F.lit(0)), F.lit(500_000_000)))
    day = F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(-1 << 63)).alias("key"),
        F.col(url).alias("url"), text_of(html).alias("html"), digest.alias("digest"), size.alias("size"),
        day.alias("day"))
    joined = rows.join(fate, (F.col("key") == F.col("fate_id")) & (F.col("digest") == F.col("fate_digest")), "left")
    end = F.lit("\r\n")
    again = F.col("first").isNotNull()

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    joined = joined.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), end,
        F.lit("WARC-Record-ID: "), name("id"), end, F.lit("WARC-Date: "), F.col("day"), end,
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), safe, end)),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("first"), end))
        .otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), end,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block"))
    (joined.select(record.alias("value")).write.mode("error").option("lineSep", "\r\n\r\n")
     .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder))


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query, lower case, fragment left out."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:  # not a URL
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def records(data: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(position, length, headers, block) of each record of an archive, found by the lengths that the headers state."""
    raw, at = bytes(data), 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, end + 4 - at, head, data[begin:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name and name != "none" else None


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures in the archives of `folder`; those of one archive come as one run, sorted by key and time.

    Positions are those in the unpacked archive. Payloads are read back in full: a digest that differs from the one in the header ends the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for at, length, head, block in records(memoryview(gzip.decompress(content.as_buffer()))):
                    raw = bytes(block)
                    cut = raw.index(b"\r\n\r\n") + 4
                    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response":
                        size, digest = len(raw) - cut, hashlib.sha1(raw[cut:]).hexdigest()
                        if digest != stated:
                            raise ValueError(f"payload digest differs at {at} of {path}")
                    else:  # the full payload's length stands in the stored response header
                        http = dict(x.split(": ", 1) for x in raw[:cut - 4].decode().split("\r\n")[1:])
                        size, digest = int(http["Content-Length"]), stated
                    url = head.get("WARC-Target-URI")
                    rows.append((url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), url, kind, size, digest,
                                 _page(head.get("WARC-Refers-To")), path.as_py().rsplit("/", 1)[-1], at, length))
                rows.sort(key=_order)
                cols = list(zip(*rows, strict=True)) or [[]] * len(INDEX)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, INDEX, strict=True)],
                                                 schema=INDEX)

    return files.mapInArrow(parse, INDEX_SQL)


def _order(row) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so the next least takes one match per level."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [0] * max(1, self.k)
        self.tree[0] = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x <= y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self):
        while self.k and self.head[win := self.tree[0]] is not None:
            yield self.head[win]
            self.head[win] = next(self.runs[win], None)
            node = (win + self.k) // 2
            while node:
                if not self._less(win, self.tree[node]):
                    win, self.tree[node] = self.tree[node], win
                node //= 2
            self.tree[0] = win


def merge_runs(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """The captures of all runs in global order of URL key and time.

    The key space is cut into ranges of about `rows_per_range` captures, by URL key, time and page, so that a host or
    a URL with very many captures spans several ranges. Each range merges its part of every run by a loser tree.
    The rows come out sorted inside each partition, and partitions are in order.
    """
    runs = Scratch(runs.sparkSession, "runs").keep(runs, "sorted")  # external runs; sampled for the ranges, then read
    parts = parts_for(runs.count(), rows_per_range)
    ranged = runs.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "position")

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        keys = list(zip(*(whole.column(c).to_pylist() for c in
                          ("url_key", "captured", "page_id", "archive", "position")), strict=True))
        by_run: dict[str, list] = {}
        for i, (key, day, page, run, at) in enumerate(keys):
            by_run.setdefault(run, []).append((key, day, page is None, page or 0, run, at, i))
        for run in by_run.values():
            run.sort()  # one pass over a run that arrived in order; blocks of a shuffle may not
        order = [k[-1] for k in LoserTree(list(by_run.values()))]
        yield from whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(merge, INDEX_SQL)


def archive_and_index(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write `pages` to WARC archives in `folder`, read them back, and return their index in global order.

    One row per row of `pages`: `url_key, captured, page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, archive, position, length`. An empty table gives an empty index.
    """
    write_archives(pages, folder, **options)
    return merge_runs(read_runs(pages.sparkSession, folder))
