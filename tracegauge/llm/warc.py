"""Zstandard WARC archives: a writer, and a reader that decodes one frame per record.

An archive begins with a skippable frame that holds its dictionary; every record is a frame of its own,
compressed with that dictionary. Tasks write archives of about ``ARCHIVE_BYTES`` of payload each under fresh names and
return a manifest row per archive; the manifest is a written table, so archives of failed or repeated attempts
are never read. The reader streams an archive: it never holds more than one record.

Equal payloads of at least ``MIN_SHARED`` bytes are stored once, in the record of the smallest id; the others
become ``revisit`` records that refer to it. Null payloads count as empty, null URLs are left out of the header; null
ids come after all others. Rows that repeat id and payload are all responses if they hold the smallest id.

Archives go through ``pyarrow.fs`` to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import materialize, partitions, shared_path

MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
#: Payload bytes that an archive's dictionary is trained on, at most so many of each record, and the dictionary's size.
TRAIN_BYTES, TRAIN_EACH, DICTIONARY_BYTES = 1 << 20, 16 << 10, 32 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
_CHUNK = 1 << 18


class BadArchive(ValueError):
    pass


# --- records -------------------------------------------------------------------------------------


def record(row_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit (headers only) where ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:row:{'' if row_id is None else row_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields, after its version, headers, lengths and digest have been checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or version != "WARC/1.1":
        raise BadArchive(f"not a record: {version[:40]!r}")
    named = {}
    for line in lines:
        key, colon, value = line.partition(": ")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]!r}")
        named[key.lower()] = value
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(named)
    if missing:
        raise BadArchive(f"missing headers: {sorted(missing)}")
    length = int(named["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"block of {len(rest) - 4} bytes, header says {length}")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    size = re.search(rb"(?mi)^content-length: ([0-9]+)\r?$", http)
    if not sep or not size:
        raise BadArchive("no HTTP header")
    kind, digest = named["warc-type"], named["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive("the payload is not what its header says")
    if kind == "revisit" and (payload or "warc-refers-to" not in named):
        raise BadArchive("a revisit has no payload and refers to a record")
    return {"id": _number(named["warc-record-id"]), "kind": kind, "size": int(size[1]), "digest": digest,
            "refers_to": _number(named.get("warc-refers-to", "")), "url": named.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def _number(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:row:(-?[0-9]+)>", urn)
    return int(m[1]) if m else None


# --- archives ------------------------------------------------------------------------------------


def train(samples: list[bytes]) -> bytes:
    """A dictionary; too few or too small samples give a plain one, of their bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write(out: BinaryIO, records: Iterator[bytes], dictionary: bytes) -> int:
    """The dictionary's frame (itself compressed), then a frame for each record."""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    how = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **how)
    n = 0
    for raw in records:
        out.write(press.compress(raw))
        n += 1
    return n


def read(src: BinaryIO) -> Iterator[bytes]:
    """Every record's bytes. One frame is decoded at a time; what follows it in the buffer is kept for the next."""
    head = src.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadArchive("no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    body = src.read(size)
    if len(body) != size:
        raise BadArchive("the dictionary frame is cut short")
    dictionary = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME) else body
    how = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    unpress = zstandard.ZstdDecompressor(**how)
    buffer = b""
    while buffer or (buffer := src.read(_CHUNK)):
        frame, parts = unpress.decompressobj(), []
        while True:
            parts.append(frame.decompress(buffer))
            if frame.eof:
                buffer = frame.unused_data
                break
            if not (buffer := src.read(_CHUNK)):
                raise BadArchive("the last record is cut short")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives below ``folder``; returns the manifest (archive, records)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    # the first id of every shared payload: partial minima before the shuffle, a skewed join may be split after it
    firsts = rows.where(F.col("size") >= MIN_SHARED).groupBy("digest").agg(F.min("id").alias("first"))
    joined = rows.join(firsts.withColumnRenamed("digest", "same"), (F.col("digest") == F.col("same")) & (F.col("size") >= MIN_SHARED), "left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    planned = joined.select("id", "url", F.when(~again, F.col("body")).alias("body"), "size", "digest", F.when(again, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = []
        for row in rows:
            held, size, trained = [row], len(row[2] or b""), 0
            while size < TRAIN_BYTES and (row := next(rows, None)) is not None:
                held.append(row)
                size += len(row[2] or b"")
            samples = [h[2][:TRAIN_EACH] for h in held if h[2]]
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"

            def records(held=held):
                full = 0
                for h in held:
                    full += len(h[2] or b"")
                    yield record(h[0], h[1], h[2], h[3], h[4], h[5])
                while full < ARCHIVE_BYTES and (h := next(rows, None)) is not None:
                    full += len(h[2] or b"")
                    yield record(h[0], h[1], h[2], h[3], h[4], h[5])

            with store.open_output_stream(path) as out:
                n = write(out, records(), train(samples) if samples else b"")
            done.append((path.removeprefix(root).lstrip("/"), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return materialize(planned.mapInArrow(run, "archive string, records bigint"), "manifest")


FIELDS = "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(manifest: DataFrame, folder: str, id_col: str = "page_id", contents: bool = False) -> DataFrame:
    """One row per record: id, full payload's size and digest, type, and for revisits the record they refer to; ``contents`` adds url and payload."""
    extra = ", url string, payload binary" if contents else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, root = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(f"{root}/{name}") as src:
                    n, held = 0, []
                    for raw in read(src):
                        held.append(parse(raw))
                        n += 1
                        if len(held) == (64 if contents else 1024):
                            yield shaped(held)
                            held = []
                    if held:
                        yield shaped(held)
                if n != expected:
                    raise BadArchive(f"{name} has {n} records, the manifest says {expected}")

    def shaped(held: list[dict]) -> pa.RecordBatch:
        cols = [("id", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64())]
        cols += [("url", pa.string()), ("payload", pa.binary())] if contents else []
        names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in cols], names=names[:len(cols)])

    # an archive is a task's work
    return manifest.repartition(partitions(manifest.sparkSession), "archive").mapInArrow(run, f"`{id_col}` bigint, {FIELDS}{extra}")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(pages, folder, id_col, url, payload), folder, id_col)
