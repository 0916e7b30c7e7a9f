"""WARC archives: writing, normalising and reading.

Crawlers often gzip a whole archive as one stream, which can only be read from
its start. The normaliser inflates such a stream once, record by record, and
writes every record as a gzip member of its own, with a sidecar index of
offsets and lengths; then any record can be read alone.

Archives lie in a folder that driver and executors share. A file appears under
its name only when it is whole, and no two attempts of a task share a name: the
rows that come back name the files of the attempt that counts, and what a lost
executor left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewise.llm.common import as_bytes, broadcast_if_small, small_batches
from slopewise.session import cut

#: Bytes of records, before compression, after which a writer begins the next archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that are read from an archive at once.
READ_BYTES = 1 << 18
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
GZIP = 31
INDEX = "archive string, offset long, length long, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def _whole_file(uri: str) -> Iterator[BinaryIO]:
    """Writes beside the name and moves the file there when it is complete."""
    store, path = _store(uri)
    part = f"{path}.part"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    store.move(part, path)


def _own_name() -> str:
    """A name that no other task and no other attempt of this one has."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def remove(uri: str) -> None:
    store, path = _store(uri)
    store.delete_dir(path)


def _make_dir(uri: str) -> None:
    store, path = _store(uri)
    store.create_dir(path, recursive=True)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value without line breaks or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id: int | None, url: str | None, place: str = "") -> str:
    """The id of a page's record; place tells records apart that agree in page_id and url."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None, place: str = "") -> bytes:
    """One WARC 1.1 record; a revisit carries the digest and length of the payload and names the page that has it, but not the payload."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, place)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _field(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _field(refers_url)))
        block = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file piece by piece, whether it is one member or many."""
    unzip = zlib.decompressobj(GZIP)
    begun = False
    while data := source.read(READ_BYTES):
        while data:
            if unzip.eof:
                unzip, begun = zlib.decompressobj(GZIP), False
            begun = True
            yield unzip.decompress(data, READ_BYTES)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, READ_BYTES)
            data = unzip.unused_data
    if begun and not unzip.eof:
        raise EOFError("the archive ends inside a gzip stream")


def records_of(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and the whole bytes of each record of a gzip file, one record in memory at a time."""
    held = bytearray()
    pieces = _inflated(source)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise EOFError("the archive ends inside a record")
                return
        fields = parse_head(bytes(held[:end]))
        whole = end + 4 + int(fields["content-length"]) + 4
        while len(held) < whole:
            if not more():
                raise EOFError("the archive ends inside a record")
        yield fields, bytes(held[:whole])
        del held[:whole]


def content(fields: dict[str, str], data: bytes) -> dict:
    """What a record says of its page; the payload of a revisit is None."""
    revisit = fields["warc-type"] == "revisit"
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
    payload = None
    if not revisit:
        payload = data[data.index(b"\r\n\r\n", data.index(b"\r\n\r\n") + 4) + 4 : -4]
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(fields["x-payload-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest32(payload),
        "record_type": fields["warc-type"],
        "refers_to": None if refers is None else int(refers),
        "payload": payload,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, refers_url, again): refers_to is the smallest page_id with the same payload where that is another page.

    refers_url is that page's url, the smallest if it has several. Payloads are
    told apart by length and SHA-1, which are found before any shuffle; only
    pages that have a twin come back to the payloads. again is true for rows
    that share page_id and url with others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(as_bytes(F.col("html")), as_bytes(F.lit(""))).alias("payload"))
    known = rows.where("page_id is not null").select("page_id", "url", F.octet_length("payload").alias("n"), F.unhex(F.sha1("payload")).alias("digest")).where(F.col("n") >= min_bytes)
    known = cut(known)
    first = known.groupBy("n", "digest").agg(F.min(F.struct("page_id", "url")).alias("f"), F.max("page_id").alias("other")).where("f.page_id <> other")
    # The negated length makes the join deal both sides anew, so that adaptive execution can split a frequent payload.
    first = first.select((-F.col("n")).alias("m"), "digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url"))
    twins = known.withColumn("m", -F.col("n")).join(first, ["m", "digest"]).where("page_id <> refers_to")
    twins = cut(twins.select(F.col("page_id").alias("twin"), "refers_to", "refers_url", "n", "digest").distinct())
    twins = broadcast_if_small(twins)  # then the payloads need no shuffle
    same = (rows["page_id"] == twins["twin"]) & (F.octet_length(rows["payload"]) == twins["n"]) & (F.unhex(F.sha1(rows["payload"])) == twins["digest"])
    again = rows.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("p", "u", F.lit(True).alias("again"))
    again = broadcast_if_small(cut(again))
    marked = rows.join(twins, same, "left").join(again, rows["page_id"].eqNullSafe(again["p"]) & rows["url"].eqNullSafe(again["u"]), "left")
    return marked.select("page_id", "url", "payload", "refers_to", "refers_url", F.coalesce("again", F.lit(False)).alias("again"))


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes rows of mark_revisits as archives that are one gzip stream each; returns (archive, records, bytes)."""
    small_batches(pages.sparkSession)
    _make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _own_name(), 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name = f"{folder}/part-{own}-{number:04d}.warc.gz"
            n = size = 0
            with _whole_file(name) as out:
                packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                while row is not None and size < archive_bytes:
                    *fields, again = row
                    data = record(*fields, place=f"{own}:{number}:{n}" if again else "")
                    out.write(packer.compress(data))
                    n, size, row = n + 1, size + len(data), next(rows, None)
                out.write(packer.flush())
            number += 1
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]})

    return pages.mapInArrow(write, "archive string, records long, bytes long")


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each archive with one gzip member a record and a sidecar index; returns the index rows.

    The sidecar, named like the archive with .idx at the end, has a line of
    JSON for each record. Truncated archives raise an error.
    """
    _make_dir(folder)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{folder}/{_own_name()}-{archive.rsplit('/', 1)[1]}"
                offsets, lengths, pages = [], [], []
                at = 0
                store, path = _store(archive)
                with store.open_input_stream(path, compression=None) as source, _whole_file(name) as out:
                    for fields, data in records_of(source):
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        page = fields.get("x-page-id")
                        offsets.append(at)
                        lengths.append(len(member))
                        pages.append(None if page is None else int(page))
                        at += len(member)
                with _whole_file(f"{name}.idx") as out:
                    for row in zip(offsets, lengths, pages, strict=True):
                        out.write(json.dumps(dict(zip(("offset", "length", "page_id"), row, strict=True))).encode() + b"\n")
                for k in range(0, len(offsets), 10_000):
                    cols = [pa.array([name] * len(offsets[k : k + 10_000])), *(pa.array(c[k : k + 10_000], pa.int64()) for c in (offsets, lengths, pages))]
                    yield pa.RecordBatch.from_arrays(cols, ["archive", "offset", "length", "page_id"])

    # No shuffle: the names stay in the partitions of the tasks that wrote the archives, which spreads the work alike.
    return archives.select("archive").mapInArrow(rewrite, INDEX)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Reads each indexed record alone, by seeking to its member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if opened is None or opened[0] != archive:
                    if opened is not None:
                        opened[1].close()
                    store, path = _store(archive)
                    opened = archive, store.open_input_file(path)
                opened[1].seek(offset)
                data = zlib.decompress(opened[1].read(length), GZIP)
                row = content(parse_head(data[: data.index(b"\r\n\r\n")]), data)
                out.append(row if payloads else row | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
        if opened is not None:
            opened[1].close()

    return index.mapInArrow(read, RECORD)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages to whole-stream archives under folder, normalises them, and returns the index of the result.

    A null html is an empty payload, a null url leaves its header out. Of pages
    with equal payloads of at least min_bytes bytes, that with the smallest
    page_id is a response and the others revisit it; rows that repeat that
    smallest page_id are responses too. Rows without a page_id are responses
    that nothing refers to. An empty table gives no archives.
    """
    archives = cut(write_monolithic(mark_revisits(pages, min_bytes), f"{folder}/whole"))
    index = cut(normalise(archives, f"{folder}/members"))
    remove(f"{folder}/whole")
    return index

