"""WARC archives: a writer, and a salvage reader that goes on after damage."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"


@dataclass(frozen=True)
class Archive:
    """Settings of the writer and the reader.

    compress     one gzip member per record, as usual; else plain records
    file_bytes   a writer opens its next file beyond so many bytes
    read_bytes   the reader asks for so many bytes at a time
    most_bytes   longest record that a damaged length may ask for before it counts as damage
    """

    compress: bool = True
    level: int = 2
    file_bytes: int = 64 << 20
    read_bytes: int = 1 << 20
    most_bytes: int = 1 << 30


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes, job: Archive) -> bytes:
    """One record, as a gzip member of its own where asked."""
    head = b"\r\n".join([VERSION, *[f"{k}: {v}".encode() for k, v in fields.items()], b"Content-Length: %d" % len(block)])
    raw = head + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not job.compress:
        return raw
    z = zlib.compressobj(job.level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, job: Archive) -> bytes:
    """A response with its payload, or a revisit that names the record it repeats."""
    kind = "response" if refers_to is None else "revisit"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    block = payload if refers_to is None else b""
    fields["WARC-Block-Digest"] = f"sha1:{digest_of(block)}"
    return record(fields, block, job)


# ---- the salvage reader -------------------------------------------------------------------


class _Window:
    """A file read forwards in steps, with the bytes from ``start`` on in memory."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.start, self.held, self.ended = stream, step, 0, bytearray(), False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(self.step)
        self.ended = not got
        self.held += got
        return bool(got)

    def upto(self, size: int) -> bool:
        while len(self.held) < size:
            if not self.more():
                return False
        return True

    def drop(self, size: int) -> None:
        del self.held[:size]
        self.start += size


class Damaged(Exception):
    """A record failed a check; the message says which."""


def _parsed(raw: bytes) -> dict:
    """The fields of one whole record (without its closing blank lines) after all checks."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    length = int(fields["content-length"])
    if block[length:] != b"\r\n\r\n":
        raise Damaged("content length does not meet the end of the record")
    block = bytes(block[:length])
    told = fields.get("warc-block-digest")
    if told is not None and told != f"sha1:{digest_of(block)}":
        raise Damaged("block digest")
    return {"fields": fields, "block": block}


def _gzip_member(w: _Window, job: Archive) -> tuple[bytes, int]:
    """The content of the member at the window's start, and its compressed size."""
    if not w.upto(18) or w.held[:3] != MAGIC:
        raise Damaged("no gzip member")
    z = zlib.decompressobj(31)
    out, at = bytearray(), 0
    while not z.eof:
        if at >= len(w.held) and not w.more():
            raise Damaged("gzip member cut off")
        part = bytes(w.held[at : at + job.read_bytes])
        try:
            out += z.decompress(part)
        except zlib.error as e:
            raise Damaged("gzip member broken") from e
        if not out.startswith(b"WARC/1.") and len(out) >= 7:
            raise Damaged("no version line")
        if len(out) > job.most_bytes:
            raise Damaged("record too long")
        at += len(part)
    return bytes(out), at - len(z.unused_data)


def _plain_record(w: _Window, job: Archive) -> tuple[bytes, int]:
    w.upto(8)
    if not w.held.startswith(b"WARC/1."):
        raise Damaged("no version line")
    at = w.held.find(b"\r\n\r\n")
    while at < 0:
        if len(w.held) > 1 << 20 or not w.more():
            raise Damaged("header does not end")
        at = w.held.find(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in bytes(w.held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not lengths or not lengths[0].isdigit() or int(lengths[0]) > job.most_bytes:
        raise Damaged("no content length")
    size = at + 4 + int(lengths[0]) + 4
    if not w.upto(size):
        raise Damaged("record cut off")
    return bytes(w.held[:size]), size


def salvage(stream, job: Archive = Archive()) -> Iterator[dict]:
    """Every sound record of an archive, and a row for every gap between them.

    A record is sound if its gzip member (its own check sum included), version line, header,
    content length and block digest hold. At the first failure the reader goes on to the next
    place where a member or a version line begins and tries again; the bytes from the failure
    to the next sound record are one gap with the first reason. Memory is bounded by the
    longest record.
    """
    w = _Window(stream, job.read_bytes)
    gap_from, reason = None, ""
    while True:
        if not w.upto(1):
            break
        try:
            zipped = w.upto(3) and w.held[:3] == MAGIC
            raw, size = (_gzip_member if zipped else _plain_record)(w, job)
            got = _parsed(raw)
        except Damaged as e:
            if gap_from is None:
                gap_from, reason = w.start, str(e)
            w.drop(1)
            while True:  # the next member or version line
                at = min((p for p in (w.held.find(MAGIC), w.held.find(b"WARC/1.")) if p >= 0), default=-1)
                if at >= 0:
                    w.drop(at)
                    break
                w.drop(max(0, len(w.held) - 6))  # a mark may lie across two reads
                if not w.more():
                    w.drop(len(w.held))
                    break
            continue
        if gap_from is not None:
            yield {"gap": (gap_from, w.start, reason)}
            gap_from = None
        yield got | {"at": w.start, "size": size}
        w.drop(size)
    if gap_from is not None:
        yield {"gap": (gap_from, w.start, reason)}


# ---- Spark ----------------------------------------------------------------------------------


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and the page that a revisit refers to (null: response).

    The digest groups hold ids alone and only groups of two or more are kept, so one payload
    that very many pages share is one row per task; it is a hash of the group's key that the
    pages are joined by, and adaptive execution splits a hot one.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    groups = base.where("page_id is not null").groupBy("sha").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("first"))
    groups = materialize(groups.where("first < keeper").select("sha", "keeper"), "payload-groups")
    return base.join(groups, "sha", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, job: Archive = Archive()) -> DataFrame:
    """Write one record per row of ``pages`` under ``folder``; returns the manifest (path,
    records, bytes) as a written table.

    Files have names of their own, and only those in the manifest count: what a failed or
    repeated task left behind is never read. ``folder`` is one that all executors share.

    A null html is an empty payload. Of rows with equal payloads those with the largest
    page_id are responses (rows that repeat it too), the others revisits; a null page_id is
    a response of its own. No rows give an empty manifest; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        out, path, count, size = None, "", 0, 0
        ending = "warc.gz" if job.compress else "warc"

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and size >= job.file_bytes:
                    yield closed()
                    out = None
                if out is None:
                    path, count, size = f"{root.rstrip('/')}/pages-{uuid.uuid4().hex}.{ending}", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                raw = page_record(page_id, url, payload, digest_of(payload), refers_to, job)
                out.write(raw)
                count, size = count + 1, size + len(raw)
        if out is not None:
            yield closed()

    return materialize(planned(pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


SALVAGED = (
    "path string, at long, bytes long, gap_reason string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def read(files: DataFrame, folder: str, job: Archive = Archive(), payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``files`` (path), read by ``salvage``; damaged byte
    ranges come as rows with a gap_reason. One task reads a file at a time and streams it.

    A path that is null is skipped; an empty file gives nothing.
    """

    def number(told: str | None) -> int | None:
        digits = (told or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(folder)
        schema = pa.schema([
            ("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("gap_reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
            ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for got in salvage(stream, job):
                        if "gap" in got:
                            start, end, reason = got["gap"]
                            rows.append({"path": path, "at": start, "bytes": end - start, "gap_reason": reason})
                        else:
                            f, block = got["fields"], got["block"]
                            response = f.get("warc-type") != "revisit"
                            told = f.get("x-payload-length", "")
                            rows.append({
                                "path": path, "at": got["at"], "bytes": got["size"], "page_id": number(f.get("warc-record-id")), "url": f.get("warc-target-uri"),
                                "record_type": f.get("warc-type"), "payload_bytes": len(block) if response else int(told) if told.isdigit() else None,
                                "payload_digest": digest_of(block) if response else f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                "refers_to": None if response else number(f.get("warc-refers-to")), "payload": block if payloads and response else None,
                            })
                            held += len(block)
                        if len(rows) >= 2_000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(run, SALVAGED)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, job: Archive = Archive()) -> DataFrame:
    """Write ``pages`` as archives and read them back: one row per record and per gap."""
    manifest = write(pages, folder, job)
    files = manifest.repartitionByRange(max(1, min(10_000, manifest.count())), "path")
    return read(files, folder, job, payloads=False)
