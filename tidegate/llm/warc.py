"""WARC archives: a writer that stores repeated payloads once, and a sequential reader.

Each record is a gzip member of its own. Tasks write archives below the shared
folder through Arrow's file systems, under names no other attempt uses, and only
names that a finished job returned are read, so a lost or repeated task leaves
at most an unread file. The reader inflates in small pieces, frames records by
their Content-Length and checks every block and payload digest on the way.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, written

MAX_READERS = 100_000            # tasks that read archives; with more archives a task reads several
ARCHIVE_BYTES = 64 << 20        # an archive is closed once it holds this many bytes
_PIECE = 1 << 16
# Fixed values of the format.
VERSION, LINE, END = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


@dataclass
class Record:
    """One record as read: its place, named fields and what the digests were checked on."""

    offset: int
    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def base32_sha1(sha) -> str:
    return b32encode(sha.digest()).decode()


def _page(name: str | None) -> int | None:
    """The page of a record id; None for the id of a NULL page."""
    inner = (name or "").strip("<>")
    return int(inner[len(_ID):]) if inner[len(_ID):] else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None, revisit: bool) -> bytes:
    """The gzip member of a record; a revisit has the HTTP head without the payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    name = "" if page_id is None else page_id
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{name}>"),
        ("WARC-Date", date),
        # a line break would end the field
        ("WARC-Target-URI", None if url is None else "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(hashlib.sha1(payload))}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block))}"),
        ("WARC-Refers-To", f"<{_ID}{'' if refers_to is None else refers_to}>" if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = LINE.join(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + LINE + lines + END + block + END) + packer.flush()


class _Inflated:
    """Bytes of the gzip members of a stream, one member after the other, inflated as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.taken, self.member = stream, b"", 0, None
        self.ready = b""

    def _read(self) -> bytes:
        piece = self.stream.read(_PIECE)
        self.taken += len(piece)
        return piece

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if self.member is not None:
            self.raw = self.member.unused_data
        if not self.raw:
            self.raw = self._read()
            if not self.raw:
                return False
        self.offset = self.taken - len(self.raw)
        self.member, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """Some further bytes of the member, b"" at its end."""
        if self.ready:
            out, self.ready = self.ready, b""
            return out
        while not self.member.eof:
            data = self.member.unconsumed_tail or self.raw or self._read()
            if not data:
                raise ValueError(f"the archive ends inside the member at {self.offset}")
            self.raw = b""
            out = self.member.decompress(data, _PIECE)
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, of any number; only the end of what is held is searched again."""
        found, searched = bytearray(), 0
        while (at := found.find(mark, searched)) < 0:
            searched = max(0, len(found) - len(mark) + 1)
            piece = self.more()
            if not piece:
                raise ValueError(f"no end of the header in the member at {self.offset}")
            found += piece
        self.ready = bytes(found[at + len(mark):])
        return bytes(found[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.more()
            if not piece:
                raise ValueError(f"the member at {self.offset} is shorter than its Content-Length")
            if len(piece) > n:
                piece, self.ready = piece[:n], piece[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.decode("utf-8", "surrogatepass").partition(":") for line in head.split(LINE)[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream, with_payload: bool = False) -> Iterator[Record]:
    """All records of a gzip stream in order; wrong framing or a wrong digest raises ValueError.

    A revisit has no payload of its own: its length and digest are those that the
    record states. Without ``with_payload`` no block is held whole.
    """
    source = _Inflated(stream)
    while source.next_member():
        head = source.until(END)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record in the member at {source.offset}")
        fields = _fields(head)
        block_sha, payload_sha, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = False
        for piece in source.exactly(int(fields["content-length"])):
            block_sha.update(piece)
            if not inside:
                http += piece
                if END not in http:
                    continue
                http, _, piece = http.partition(END)
                inside = True
            payload_sha.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(source.exactly(4)) != END or source.more():
            raise ValueError(f"the record at {source.offset} does not end after its Content-Length")
        if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block_sha)}":
            raise ValueError(f"wrong block digest at {source.offset}")
        stated = fields.get("warc-payload-digest", "")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and stated != f"sha1:{base32_sha1(payload_sha)}":
            raise ValueError(f"wrong payload digest at {source.offset}")
        if revisit:
            size = int(_fields(http)["content-length"])
        yield Record(source.offset, fields, size, stated.removeprefix("sha1:"),
                     b"".join(kept) if with_payload and not revisit else None)


def owners(pages: DataFrame, min_revisit_bytes: int = 0, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """page_id, url-free payload columns and the page that holds the payload: revisit, refers_to.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the record with the
    largest page_id is the response; rows that repeat that id are responses too.
    NULL ids count as smallest; where all are NULL, all are responses.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    digest, size = F.sha1(body), F.octet_length(body)
    heads = pages.select(F.col(page_id).alias("p"), digest.alias("d"), size.alias("n")).where(
        F.col("n") >= min_revisit_bytes).groupBy("d", "n").agg(F.max("p").alias("owner"), F.count("*").alias("copies"))
    # stored, so that the join's two sides are plain shuffles and a payload with very many pages can be split
    shared = written(heads.where("copies > 1").select("d", "n", "owner", F.lit(True).alias("shared")), "shared")
    rows = pages.withColumns({"d": digest, "n": size})
    return rows.join(shared, ["d", "n"], "left").withColumn(
        "revisit", F.coalesce(F.col("shared") & ~F.col(page_id).eqNullSafe(F.col("owner")), F.lit(False)))


def write_archives(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    page_id: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row and return the stored list of archives: path, records, bytes.

    NULL payloads are empty; NULL urls have no target field. Other columns are
    not written. ``folder`` is a path or address that Arrow's file systems open.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    rows = owners(own, min_revisit_bytes).select("page_id", "url", "html", "revisit", "owner")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for page, address, html, revisit, owner in zip(*batch.columns):
                if out is None:
                    name, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                member = encode_record(page.as_py(), address.as_py(), body, date, owner.as_py(), revisit.as_py())
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"])

    return written(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives: path, offset, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (bare base32) and, on request, payload (NULL for revisits)."""
    schema = ("path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, "
              "payload_bytes bigint, payload_digest string") + (", payload binary" if with_payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for r in read_records(stream, with_payload):
                        f = r.fields
                        revisit = f["warc-type"] == "revisit"
                        rows.append((
                            path, r.offset, _page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"],
                            _page(f["warc-refers-to"]) if revisit else None, r.payload_bytes, r.payload_digest,
                            r.payload)[:len(names)])
                        held += len(r.payload or b"") + 200
                        if held >= 8 << 20:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names, kinds)

    # dealt to a stated number of partitions: adaptive execution would merge so small a table into one
    return archives.select("path").repartition(min(MAX_READERS, max(1, archives.count()))).mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, after writing and reading back.

    Null pages have NULL ids; repeated rows are records of their own; an empty table gives no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, min_revisit_bytes)
    return read_archives(archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
