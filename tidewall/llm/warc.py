"""WARC archives of pages, and an index of captures merged from sorted runs.

Writing: payloads are digested, the least page of each payload is its response and the others revisit
it; every record is one string and Spark's text writer lays the records in gzip files, with the two line
ends that close a record as its separator. So archives are written by Spark's own committer.

Reading: archives come through Spark's binary reader, and records are found by their content lengths.

Index: each archive read gives a capture run sorted by URL key, time and page. Captures are dealt to ranges
of keys, and each range merges what it got of every run with a tree of losers. Ranges follow each other, so
all captures are in one global order, a URL's together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm.common import shared_dir, stored

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Captures have no time of their own: page n is taken n seconds, modulo ten years, after 2024 began.
FIRST_SECOND, SECONDS = 1_704_067_200, 315_360_000
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured long, row long"
NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits, or 5 hex digits, become 4 letters."""
    digits = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]), HEX32, BASE32)


def with_records(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """page_id, row, url, html with payload_bytes, payload_digest, record_type, refers_to and first_row.

    Of rows with one payload of least_bytes or more, those with the least page_id are responses, the others
    revisit it (first_row is one of its rows); a null page_id is a response that none refers to. Rows are
    dealt once, to as many partitions as payloads of archive_bytes would fill. Payloads that more than a
    4096th of all rows share are fewer than 4096, so they are broadcast, and their rows dealt one by one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html").cast("long") + 500), F.lit(0))).first()
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    groups = rows.groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stored(groups, "payloads")
    hot = max(64, n // 4096)
    common = groups.filter(F.col("_n") > hot).select(F.col("_digest").alias("payload_digest"), F.col("_bytes").alias("payload_bytes"), F.col("_first").alias("_hot"))
    rare = groups.filter(F.col("_n") <= hot).select(F.concat_ws(":", "_digest", "_bytes").alias("_key"), F.col("_first").alias("_rare"))
    rows = rows.join(F.broadcast(common), ["payload_digest", "payload_bytes"], "left")
    key = F.when(F.col("_hot").isNull(), F.concat_ws(":", "payload_digest", "payload_bytes")).otherwise(F.concat(F.lit("row:"), F.col("row")))
    archives = max(1, -(-size // archive_bytes))
    joined = rows.withColumn("_key", key).repartition(archives, "_key").join(rare, "_key", "left").withColumn("_first", F.coalesce("_hot", "_rare"))
    revisit = F.coalesce((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("_first.page_id")), F.lit(False))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first.page_id")), "first_row": F.when(revisit, F.col("_first.row"))}).drop("_key", "_hot", "_rare", "_first")


def record_text(df: DataFrame) -> DataFrame:
    """One string per row: the WARC record without its closing line ends. A record's id names page and row."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    safe_url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, F.col("html")))
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    at = F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id", "row")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn("refers_to", "first_row"))).otherwise(""),
        F.when(F.col("record_type") == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        line("WARC-Target-URI", safe_url),
        line("WARC-Date", at),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return df.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 20_000, archive_bytes: int = 64 << 20) -> None:
    """Writes a record per row of pages (page_id, url, html) as gzip WARC files below path, of about archive_bytes at most."""
    record_text(with_records(pages, least_bytes, archive_bytes)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query, in lower case; "" without a host."""
    if not url or "://" not in url:
        return ""
    host, _, rest = url.partition("://")[2].partition("/")
    host = re.split(r"[?#]", host)[0].lower().removeprefix("www.")
    try:
        parts = urlsplit("//x/" + rest)
    except ValueError:
        return ",".join(reversed(host.split("."))) + ")/"
    return ",".join(reversed(host.split("."))) + ")/" + parts.path[1:].rstrip("/").lower() + ("?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else "")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive, plain or gzip, inflated as it is read."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while stream.readline():  # the version
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            headers[name.lower()] = value
        yield headers, stream.read(int(headers["content-length"]))
        stream.read(len(END))


def _named(urn: str | None) -> tuple[int | None, int | None]:
    """Page and row of a record's id."""
    page, _, row = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")
    return int(page) if page else None, int(row) if row else None


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (CAPTURES and `run`, its archive), each archive's in order of key, time, page and row.

    A response's bytes and digest are taken anew from its payload; a revisit has those of its headers.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block in parse_archive(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if h["warc-type"] == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["warc-payload-digest"].removeprefix("sha1:")
                    at = int(dt.datetime.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.UTC).timestamp())
                    url = h.get("warc-target-uri")
                    page, row = _named(h["warc-record-id"])
                    rows.append((page, size, digest, h["warc-type"], _named(h.get("warc-refers-to"))[0], url, url_key(url), at, row, name))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (2, 3, 5, 6, 9) else pa.int64()) for k in range(10)], names=[*NAMES, "run"])

    return files.mapInArrow(run, CAPTURES + ", run string")


def _order(row: tuple) -> tuple:
    """Key of a capture row: URL key, time, page (null first), row."""
    return (row[6], row[7], row[0] is not None, row[0] or 0, row[8])


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, k = [iter(r) for r in runs], key, len(runs)
        self.size = 1
        while self.size < max(1, k):
            self.size *= 2
        self.heads = [self._next(i) if i < k else None for i in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (a, b) if self._less(a, b) or self.heads[b] is None else (b, a)
        return won

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            node = (i + self.size) // 2
            while node:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_index(captures: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """CAPTURES with merge_range and merge_position: the global order of all captures.

    Spark cuts the keys (URL key, time, page, row) into ranges of about range_rows captures; as no two
    captures have one key, a URL or a page with very many falls into several. What a range holds of each
    run is in the run's order, and the runs are merged. `captures` should be stored.
    """
    ranges = max(1, -(-captures.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        runs: dict[str, list[tuple]] = {}
        for batch in held:
            *columns, names = (c.to_pylist() for c in batch.columns)
            for name, *row in zip(names, *columns, strict=True):
                runs.setdefault(name, []).append(tuple(row))
        for rows in runs.values():
            rows.sort(key=_order)  # no work where the shuffle kept the order
        merged = list(LoserTree(list(runs.values()), _order))
        columns = [pa.array(c, held[0].schema.field(k).type) for k, c in enumerate(zip(*merged, strict=True))]
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([*columns, pa.array([place] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64())], names=[*NAMES, "merge_range", "merge_position"])

    dealt = captures.select(*NAMES, "run").repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "row")
    return dealt.mapInArrow(merge, CAPTURES + ", merge_range int, merge_position long")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes archives of pages, reads them back, and merges the index of their captures.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, merge_range and
    merge_position, one row per row of pages. Null html is empty, null urls have no key; rows that repeat
    the least page_id of a payload are responses each; an empty table gives no rows; other columns are
    ignored.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archives(pages, path, least_bytes)
    captures = stored(read_captures(spark, path), "captures")
    return merge_index(captures).drop("url", "row")
