"""WARC archives of pages, and a globally ordered capture index by external merging of sorted runs.

`write` makes one record of each page, each record a gzip member of its own, and packs members into archives of about
ARCHIVE_BYTES (a longer record makes one alone). Rows are sorted by URL key, time and page within their partition, so
each archive is a locally sorted capture run. An archive is one value for Spark's text writer, which commits it like
any table: the writer ends a value with a line separator, which is set to the byte 0, and that is the last byte of a gzip member
(the highest of its length, if under 16 MB; behind a longer one an empty member follows). `read` inflates one member at a time
and checks lengths and payload digests; the index gives a member's offset and length in its archive, so that it can be read
alone. `merged` orders the captures of all runs: key ranges are dealt to tasks, each task gets its slice of every run, still
sorted, and merges the slices with a loser tree by (URL key, time, page).

Of records with equal payloads (SHA-1, SHA-256 and length) of at least `min_bytes`, that with the largest page_id is the
response; the others are revisits that refer to it and carry no payload. Pages have no capture time: it is EPOCH plus
page_id seconds, modulo ten years. Record ids are UUIDs whose lower 64 bits are the page_id.

Defined results: a null html is an empty payload; a null url has an empty key; a null page_id is written under an id made of url
and payload and can't be referred to (in a group without any page_id all are responses); rows that repeat the largest
page_id are responses all; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.shared import cut

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
CYCLE_SECONDS = 315_360_000
ARCHIVE_BYTES = 8 << 20
#: Bytes that are inflated at a time.
_FEED = 1 << 14
#: Index rows that a merging task holds, on average.
RANGE_ROWS = 200_000
_SPACE = 0x6F1D3C2A9B4E4D7F
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_INDEX = pa.schema([("run", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
_INDEX_SQL = "run string, place long, offset long, length long, url_key string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long"


def url_key(url: str | None) -> str:
    """Host names from right to left, then path and query; scheme, user, default port, www and fragment are dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    default = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def target(url: str | None) -> str | None:
    """The URL with all but plain URL characters escaped: what a header can hold."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else None


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(_SPACE << 64) | (page_id % 2**64))}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int % 2**64
    return low - 2**64 if low >= 2**63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured_at(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % CYCLE_SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, html: str | None, first: int | None) -> str:
    """A WARC record; `first`: the page whose payload this one repeats."""
    payload = (html or "").encode()
    revisit = first is not None and first != page_id
    block = "" if revisit else _HTTP.format(len(payload)) + (html or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest(payload)}')}>"),
        ("WARC-Date", captured_at(page_id)),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", len(payload)),
        ("X-Page-ID", page_id),
        ("WARC-Refers-To", record_id(first) if revisit else None),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block.encode())),
    ]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n" + block + "\r\n\r\n"


def _archiver(limit: int):
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archives of gzip members, each without its last byte, which is 0 and comes from the writer."""
        members, size = [], 0

        def flush() -> pa.RecordBatch:
            if members[-1][-1]:
                members.append(gzip.compress(b"", mtime=0))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], type=pa.large_binary())], names=["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "first"))
                members.append(gzip.compress(record(*row).encode(), compresslevel=6, mtime=0))
                size += len(members[-1])
                if size >= limit:
                    yield flush()
                    members, size = [], 0
        if members:
            yield flush()

    return archives


def _url_keys(column):
    return column.map(lambda url: url_key(target(url)))


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the rows (page_id, url, html) as WARC archives into the folder `path`."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "sha256": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html")})
    same = ["sha1", "sha256", "size"]
    repeated = rows.filter(F.col("size") >= min_bytes).groupBy(*same).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    key = F.pandas_udf(_url_keys, "string")
    found = rows.join(repeated, same, "left").select("page_id", "url", "html", "first").withColumn("key", key("url"))
    ordered = found.sortWithinPartitions("key", F.pmod("page_id", F.lit(CYCLE_SECONDS)), "page_id")
    archives = ordered.mapInArrow(_archiver(archive_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of an archive's gzip members."""
    at = 0
    while at < len(data):
        inflate, end, out = zlib.decompressobj(31), at, []
        while not inflate.eof:
            piece = data[end : end + _FEED]
            if not piece:
                raise ValueError(f"the member at {at} has no end")
            out.append(inflate.decompress(piece))
            end += len(piece)
        end -= len(inflate.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(run: str, archive: bytes) -> Iterator[dict]:
    """Index rows of an archive's records, in order."""
    place = 0
    for at, length, data in members(archive):
        if not data:
            continue
        head = data.index(b"\r\n\r\n")
        lines = data[:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at} of {run}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = head + 4 + int(fields["Content-Length"])
        hashed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            payload = data[data.index(b"\r\n\r\n", head + 4) + 4 : end]
            if digest(payload) != hashed or len(payload) != int(fields["X-Payload-Length"]):
                raise ValueError(f"the payload at {at} of {run} is damaged")
        if data[end:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} of {run} has a wrong length")
        page, refers = fields.get("X-Page-ID"), fields.get("WARC-Refers-To")
        yield {
            "run": run, "place": place, "offset": at, "length": length, "url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": int(page) if page else None,
            "record_type": fields["WARC-Type"], "payload_digest": hashed, "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": page_of(refers) if refers else None,
        }
        place += 1


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pylist(list(parse(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())), schema=_INDEX)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all archives in the folder, each archive a sorted run."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, _INDEX_SQL)


class LoserTree:
    """Merges sorted runs; each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.losers = k, [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._wins(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.top = winners[1] if k > 1 else (0 if k else -1)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if x >= len(self.runs[a]):
            return False
        if y >= len(self.runs[b]):
            return True
        p, q = self.runs[a][x], self.runs[b][y]
        return p < q or (p == q and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of all items in order."""
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            winner = self.top
            yield winner, self.at[winner]
            self.at[winner] += 1
            node = (winner + self.k) // 2
            while node:
                if self._wins(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.top = winner


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = list(batches)
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    names = rows.column("run").to_pylist()
    keys = list(zip(rows.column("url_key").to_pylist(), rows.column("captured").to_pylist(), (x is not None for x in rows.column("page_id").to_pylist()), (x or 0 for x in rows.column("page_id").to_pylist())))
    starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
    runs = [keys[a:b] for a, b in zip(starts, starts[1:])]
    order = [starts[run] + place for run, place in LoserTree(runs)]
    merged = rows.take(pa.array(order, type=pa.int64()))
    yield from merged.append_column("rank", pa.array(range(len(order)), type=pa.int64())).to_batches()


def merged(index: DataFrame) -> DataFrame:
    """The index rows in ranges of (url_key, captured, page_id); `range` and `rank` give the global order."""
    index = cut(index)
    ranges = max(1, -(-index.count() // RANGE_ROWS), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "place")
    return dealt.mapInArrow(_merged, _INDEX_SQL + ", rank long").withColumn("range", F.spark_partition_id())
