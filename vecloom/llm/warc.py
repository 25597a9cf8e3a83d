"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of an archive holds the seek
table of the public "Zstandard Seekable Format", and the index maps each record identifier to (archive, frame,
offset inside the frame, length).  One record costs one seek and one frame.

Archives are written by executors with pyarrow.fs into the shared folder under names that no other task attempt uses;
only archives named in the committed index count, so a lost executor or a repeated task leaves at most an orphan file.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, sent, stage

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id long, record_id string, archive string, frame int, offset int, length int"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def repeated_payloads(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages(page_id, html) -> d, n, last: digest and length of the payloads that occur more than once, and the largest page_id.

    Staged; only digests, lengths and ids are shuffled.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    facts = pages.select("page_id", F.unhex(F.sha1(payload)).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    many = facts.groupBy("d", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1 and last is not null")
    return stage(many.select("d", "n", "last"), "warc-repeated")


def revisit_plan(pages: DataFrame, min_bytes: int = 1000, few: int = 200_000) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, refers_to.

    Equal payloads are told by SHA-1 and length.  Up to `few` repeated payloads (counted; some 80 bytes each) go to the
    executors by broadcast, so no payload is shuffled; more of them meet the payloads in a shuffle join.
    """
    many = repeated_payloads(pages, min_bytes)
    many = sent(many, few)
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    j = p.join(many, (F.unhex("digest") == F.col("d")) & (F.octet_length("payload") == F.col("n")), "left")
    return j.select("page_id", "url", "payload", "digest", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def record_name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block but names the payload's digest and length."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, block) of each record in the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        top, *rest = data[at:end].decode().split("\r\n")
        if top != "WARC/1.1":
            raise ValueError(f"not a WARC record: {top[:40]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of a seekable file object."""
    size = f.seek(0, 2)
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the archive")
    f.seek(size - 9 - 8 * n)
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def read_frame(f, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=entry[2])


class ArchiveWriter:
    """Appends records; a frame closes at `frame_bytes`, an archive at `archive_bytes`."""

    def __init__(self, folder: str, frame_bytes: int, archive_bytes: int, level: int):
        import pyarrow.fs
        import zstandard

        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.frame_bytes, self.archive_bytes = folder, frame_bytes, archive_bytes
        self.zstd, self.out, self.index = zstandard.ZstdCompressor(level=level), None, []

    def add(self, page_id, record: bytes) -> None:
        import uuid

        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.frames, self.done, self.held, self.n = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), [], 0, [], 0
        self.index.append((page_id, record_name(page_id), f"{self.uri}/{self.name}", len(self.frames), self.n, len(record)))
        self.held.append(record)
        self.n += len(record)
        if self.n >= self.frame_bytes:
            self.close_frame()
            if self.done >= self.archive_bytes:
                self.close()

    def close_frame(self) -> None:
        if self.held:
            c = self.zstd.compress(b"".join(self.held))
            self.out.write(c)
            self.frames.append((len(c), self.n))
            self.done, self.held, self.n = self.done + len(c), [], 0

    def close(self) -> None:
        if self.out is not None:
            self.close_frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def _rows(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    cols = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)], names=[n for n, _ in cols])


def write_archives(plan: DataFrame, folder: str, frame_bytes: int = 1 << 18, archive_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """revisit_plan() rows -> the committed index of the archives in folder."""

    def write(batches):
        w = ArchiveWriter(folder, frame_bytes, archive_bytes, level)
        for b in batches:
            for i in range(b.num_rows):
                r = [b.column(k)[i].as_py() for k in range(5)]
                w.add(r[0], record_bytes(*r))
            if len(w.index) >= 20_000:
                yield _rows(INDEX, w.index)
                w.index = []
        w.close()
        if w.index:
            yield _rows(INDEX, w.index)

    return stage(plan.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that the index names, frame by frame, payloads of responses checked against their digest."""

    def read(batches):
        import hashlib

        import pyarrow.fs

        ident = lambda name: None if name == "<urn:page:null>" else int(name[10:-1])
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    for entry in read_seek_table(f):
                        out = []
                        for head, block in parse_records(read_frame(f, entry)):
                            digest, n, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"]
                            if kind == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                            out.append((ident(head["WARC-Record-ID"]), n, digest, kind, ident(head["WARC-Refers-To"]) if kind == "revisit" else None, head["WARC-Target-URI"]))
                        yield _rows(READ, out)

    names = index.select("archive").distinct()
    return names.repartition(max(1, names.count())).mapInArrow(read, READ)  # a task for each archive


def read_record(index: DataFrame, page_id: int) -> tuple[dict, bytes]:
    """One record by random access: index row, seek table, one frame."""
    import pyarrow.fs

    r = index.where(F.col("page_id") == page_id).first()
    fs, path = pyarrow.fs.FileSystem.from_uri(r.archive)
    with fs.open_input_file(path) as f:
        frame = read_frame(f, read_seek_table(f)[r.frame])
    return next(parse_records(frame[r.offset : r.offset + r.length]))


def archive(pages: DataFrame, min_bytes: int = 1000, **how) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, url, html) -> (index, records read back).

    Of records with equal payloads of at least min_bytes the one with the largest page_id is the response and the
    others revisit it.  Null html: an empty payload.  Null url: an empty target.  Null page_id: record id
    <urn:page:null>, always a response and never a revisit's target.  Repeated rows: each is a record, those with the largest id all
    responses.  Empty table: no archives.  Other columns are ignored.
    """
    index = write_archives(revisit_plan(pages, min_bytes), new_path(pages.sparkSession, "warc"), **how)
    return index, read_archives(index)
