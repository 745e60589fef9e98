"""Sharded WARC archives: range-sorted records, files rolled by compressed size.

Every record is a gzip member of its own. Headers, digests, lengths, dates and record
ids are made from the row alone, and the ranges from the keys alone, so a second run
writes the same bytes. Tasks write under a temporary name, rename when a file is
full, and report it; the manifest written at the end names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import open_fs, range_shards, shared_folder, slices, written

REVISIT_BYTES = 1000
# fixed value: the profile URI of the WARC 1.1 standard
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = "urn:stackrank:page"


def record_id(page_id, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_SPACE}:{page_id}:{digest}:{repeat}')}>"


def sha1_label(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def gzip_member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(kind: str, headers: list, block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers,
            ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
            ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _uri(url) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")


def page_record(page_id, url, payload: bytes, refers_to, refers_url, repeat: int,
                date: str) -> bytes:
    """A response, or, if ``refers_to`` is given, a revisit without the payload."""
    digest = hashlib.sha1(payload)
    headers = [("WARC-Record-ID", record_id(page_id, digest.hexdigest(), repeat)),
               ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
               ("WARC-Payload-Digest", sha1_label(digest.digest())),
               ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE),
                ("WARC-Refers-To", record_id(refers_to, digest.hexdigest())),
                ("WARC-Refers-To-Target-URI", _uri(refers_url)),
                ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", headers, http)


class RollingWriter:
    """Files of one shard; a new one begins when ``limit`` compressed bytes are reached."""

    def __init__(self, folder: str, shard: int, attempt: int, limit: int, date: str, level: int):
        self.fs, self.root = open_fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.date, self.level = date, level
        self.seq, self.sink, self.done = 0, None, []

    def put(self, raw: bytes):
        if self.sink is None:
            self.name = f"pages-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.tmp = f"{self.root}/.{self.name}.{self.attempt}"
            self.sink, self.size, self.records = self.fs.open_output_stream(self.tmp, compression=None), 0, 0
            info = record("warcinfo", [
                ("WARC-Record-ID", record_id("info", self.name)), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                b"format: WARC File Format 1.1\r\n")
            self._write(info)
        self._write(raw)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _write(self, raw):
        member = gzip_member(raw, self.level)
        self.sink.write(member)
        self.size += len(member)

    def close(self):
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.tmp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.seq, self.name, self.records, self.size))
            self.seq, self.sink = self.seq + 1, None


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 64 << 20,
                   shard_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the manifest: shard,
    seq, file, records, bytes.

    Of rows with equal payloads of at least 1000 bytes, those with the largest page_id
    are responses and the others revisit it; shorter payloads are always responses. Null
    html is an empty payload; a null url is written as urn:none; a null page_id sorts
    first and can only be referred to by nobody (without any id, equal payloads are
    all responses). Repeated rows get record ids of their own; other columns are
    ignored; an empty table writes no file.

    The table of repeated payloads is written first, so Catalyst sees its true size:
    small, it is broadcast; large, it is joined by sort-merge with skew splitting.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("_html"))
    slim = slim.withColumn("_digest", F.sha1(F.encode("_html", "utf-8")))
    size = F.octet_length("_html")
    best = (slim.where(size >= REVISIT_BYTES).groupBy("_digest")
            .agg(F.max(F.struct("page_id", "url")).alias("_r"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1 AND _r.page_id IS NOT NULL")
            .select("_digest", F.col("_r.page_id").alias("_to"), F.col("_r.url").alias("_to_url")))
    best = written(best, "warc-repeats")
    joined = slim.join(best, "_digest", "left")
    joined = joined.withColumn("_to", F.when(~F.col("_to").eqNullSafe(F.col("page_id")),
                                             F.col("_to")))
    placed, _ = range_shards(joined, "page_id", size + 500, shard_bytes, ["_digest", "url"])

    def run(batches):
        from pyspark import TaskContext
        out, last, repeat = None, None, 0
        for batch in batches:
            for part in slices(batch, "_html", 8 << 20):
                cols = [part.column(c).to_pylist() for c in
                        ("page_id", "url", "_html", "_to", "_to_url", "_digest")]
                for pid, url, html, to, to_url, digest in zip(*cols):
                    if out is None:
                        out = RollingWriter(folder, part.column("_shard")[0].as_py(),
                                            TaskContext.get().taskAttemptId(), file_bytes,
                                            date, level)
                    repeat = repeat + 1 if last == (pid, digest) else 0
                    last = (pid, digest)
                    out.put(page_record(pid, url, html.encode(), to, to_url, repeat, date))
        if out is not None:
            out.close()
            shard, seq, name, n, size = zip(*out.done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(seq, pa.int64()), pa.array(name),
                 pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                names=["shard", "seq", "file", "records", "bytes"])

    return written(placed.mapInArrow(run, "shard long, seq long, file string, records long, "
                                          "bytes long"), "warc-manifest")


def records(f, chunk: int = 1 << 16):
    """Raw records of an open .warc.gz, one gzip member at a time."""
    z, parts = zlib.decompressobj(31), []
    while raw := f.read(chunk):
        while raw:
            parts.append(z.decompress(raw))
            raw = b""
            if z.eof:
                yield b"".join(parts)
                raw, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    if headers["WARC-Block-Digest"] != sha1_label(hashlib.sha1(rest[:n]).digest()):
        raise ValueError("block digest differs from its header")
    return headers, rest[:n]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record
    in the files of the manifest. Block and payload digests are verified."""
    n = max(1, manifest.count())
    files = manifest.select("file").repartition(n)

    def run(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in records(f):
                        h, block = parse(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:])
                        if h["WARC-Type"] == "response" and (
                                len(payload) != size or hashlib.sha1(payload).digest() != digest):
                            raise ValueError("payload differs from its digest")
                        rows.append((_int(h.get("X-Page-ID")), size, digest.hex(), h["WARC-Type"],
                                     _int(h.get("X-Refers-To-Page-ID")), h["WARC-Target-URI"]))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _int(s):
        return None if s is None else int(s)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                   "url"])

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, **kw) -> DataFrame:
    """Write the pages and read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **kw), folder).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit'
  END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
