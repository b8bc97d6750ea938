"""WARC archives: a writer that stores equal payloads once, and a sequential reader that verifies what it reads.

An archive is one gzip member per record. The reader inflates member by member, frames each record by its content
length, never holds more than a piece of a payload, and recomputes the digests. Archives live in a folder that all
executors share, by any file system that pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, attach, portions

#: An archive is closed at this many bytes; what is read at a time; compression level.
ROLL, PIECE, LEVEL = 256 << 20, 1 << 16, 3
#: Payloads of at least this many bytes are stored once.
STORE_ONCE = 0
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the format.
VERSION, LINE, GAP = b"WARC/1.1", b"\r\n", b"\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _head(first: bytes, fields: list[tuple[str, str]]) -> bytes:
    return first + LINE + b"".join(f"{k}: {v}".encode() + LINE for k, v in fields) + LINE


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; with refers_to a revisit, which has the response's head but no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ID}{page_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress(_head(VERSION, fields) + block + GAP) + gz.flush()


class Member:
    """The inflated bytes of one gzip member of a stream, a piece at a time."""

    def __init__(self, stream: BinaryIO, begun: bytes):
        self.stream, self.raw, self.inflate, self.data = stream, begun, zlib.decompressobj(31), b""

    def fill(self) -> bool:
        while not self.inflate.eof:
            self.raw = self.raw or self.stream.read(PIECE)
            if not self.raw:
                raise ValueError("archive ends within a record")
            more = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if more:
                self.data += more
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.data:
            if not self.fill():
                raise ValueError("record without end of head")
        head, _, self.data = self.data.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.fill():
                raise ValueError("record shorter than its content length")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part

    def end(self) -> bytes:
        """Checks that nothing but the gap is left; returns what follows the member."""
        rest = b"".join(self.take(len(GAP)))
        if rest != GAP or self.data or self.fill():
            raise ValueError("record longer than its content length")
        return self.inflate.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(value: str) -> int | None:
    number = value.strip("<>").removeprefix(ID)
    return None if number == "None" else int(number)


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, in order. Raises ValueError where framing or a digest is wrong."""
    begun = stream.read(PIECE)
    while begun:
        member = Member(stream, begun)
        head = member.until(GAP)
        if not head.startswith(VERSION):
            raise ValueError("not a record")
        fields = _fields(head)
        left = int(fields["content-length"])
        whole, body = hashlib.sha1(), hashlib.sha1()
        http = member.until(GAP) + GAP
        whole.update(http)
        size = 0
        for part in member.take(left - len(http)):
            whole.update(part)
            body.update(part)
            size += len(part)
        begun = member.end() or stream.read(PIECE)
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        full = int(_fields(http.removesuffix(GAP))["content-length"])
        revisit = fields["warc-type"] == "revisit"
        if base64.b32encode(whole.digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError("block digest differs")
        if not revisit and (size != full or base64.b32encode(body.digest()).decode() != said):
            raise ValueError("payload digest differs")
        yield {
            "page_id": _page(fields["warc-record-id"]), "payload_bytes": full, "payload_digest": said, "record_type": fields["warc-type"],
            "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
        }


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, store_once: int = STORE_ONCE) -> DataFrame:
    """Writes pages as archives below folder; returns (archive, records), one row an archive.

    Files have names of their own for each attempt of a task, and only those of finished tasks are returned.
    """
    # Equal payloads are told by SHA-256; archives name them by SHA-1, as the format wants.
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("same", F.unhex(F.sha2("html", 256)))
    groups = scratch.table(rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    rows = attach(rows, groups, ["same"], "n", rows.count())
    later = (F.octet_length("html") >= store_once) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))

    def written(archive: str, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([records], pa.int64())], ["archive", "records"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in portions(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}")
                data = record(page_id, url, html.encode(), refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield written(f"{folder}/{name}", n)
        if out is not None:
            out.close()
            yield written(f"{folder}/{name}", n)

    return scratch.table(rows.mapInArrow(write, "archive string, records long"), "manifest")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives in manifest (archive, records); fails if an archive hasn't as many as it should."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, records in zip(batch["archive"], batch["records"], strict=True):
                system, path = _opened(archive)
                n, rows = 0, []
                with system.open_input_stream(path) as stream:
                    for row in read_records(stream):
                        n += 1
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _frame(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{archive} has {n} records, not {records}")
                yield _frame(rows)

    return manifest.repartition(max(1, manifest.count())).mapInPandas(read, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Of equal payloads the smallest page_id is the response and the others revisit it;
    rows that repeat that page_id are responses too, and so are equal payloads that have no page_id at all. Payloads of
    any length are written whole and read a piece at a time. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, f"{scratch.path}/archives", scratch))
