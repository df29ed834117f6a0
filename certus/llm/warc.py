"""WARC archives with per-record Zstandard frames and an embedded dictionary.

Every archive starts with a skippable frame that holds a dictionary built from
the archive's own first records; each record is then one frame, so any record
can be read alone. Tasks write archives of bounded size under names that no
other attempt uses and return a manifest of what they wrote; only what the
manifest names is read back, so what a lost task left behind does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import saved

#: Magic number of the skippable frame with the dictionary, and the revisit profile (fixed values).
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds: uncompressed bytes of an archive, sampled bytes for a dictionary, its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 1 << 20, 16 << 10
DATE, LEVEL = "2020-01-01T00:00:00Z", 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def framed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record: version, headers, block and two line ends."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of another page with its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return framed(headers, http if refers_to is not None else http + payload)


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary built from records; empty where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """One archive: buffers the first records for the dictionary, then streams."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.records, self.coder = stream, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.size, self.records = self.size + len(record), self.records + 1
        if self.coder:
            self.stream.write(self.coder.compress(record))
        else:
            self.waiting.append(record)
            if self.size >= SAMPLE_BYTES:
                self._start()

    def _start(self) -> None:
        held = dictionary(self.waiting)
        if held:
            self.stream.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        for record in self.waiting:
            self.stream.write(self.coder.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.coder:
            self._start()
        self.stream.close()


def read_records(stream, step: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    head = stream.read(8)
    held = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        held, head = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    decoder = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    rest = head
    while rest or (rest := stream.read(step)):
        frame, out = decoder.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(step)
            if not rest:
                raise ValueError("an archive ends within a record")
        yield b"".join(out)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:-4]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a record's length is wrong")
    return headers, block


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, path, made = None, "", []
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"

        def finish() -> None:
            writer.close()
            made.append((f"{folder}/{path}", writer.records, writer.size))

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for page_id, url, html, first in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    if writer is None:
                        path = f"{task}-{len(made):04d}.warc.zst"
                        writer = ArchiveWriter(store.open_output_stream(f"{base}/{path}", compression=None))
                        writer.add(framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", path), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    writer.add(page_record(page_id, url, html.encode("utf-8", "surrogatepass"), first))
                    if writer.size >= ARCHIVE_BYTES:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": [m[1] for m in made], "bytes": [m[2] for m in made]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per page below the folder and returns the manifest: path, records, bytes.

    Of pages with equal payloads (UTF-8 of html; null: empty) of at least
    ``least`` bytes, the one with the smallest page_id is a response and the
    others revisit it. Rows that repeat that page_id are responses too. A null
    page_id is never the smallest; where no page of a payload has an id, all
    are responses. A null url is left out of the record. Other columns are
    ignored. ``folder`` is a URI that driver and executors share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    # only digests that occur twice, and of those only ids, meet; pages come to their answer by id and digest
    first = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = rows.where(F.octet_length("html") >= least).select("page_id", "sha").join(first, "sha").where("not page_id <=> first_id").distinct()
    same = F.col("rows.page_id").eqNullSafe(F.col("repeated.page_id")) & (F.col("rows.sha") == F.col("repeated.sha"))
    told = rows.alias("rows").join(repeated.alias("repeated"), same, "left").select("rows.page_id", "url", "html", "first_id")
    return saved(told.mapInArrow(_written(folder), "path string, records long, bytes long"))


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"][: 2 * payloads]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for headers, block in map(parsed, read_records(stream)):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"a payload in {uri} isn't what its digest says")
                        rows.append((page_of(headers["warc-record-id"]), size, said, headers["warc-type"], page_of(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload))
                        held += len(payload) * payloads
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The page records of the archives that a manifest names.

    page_id, payload_bytes, payload_digest (of the full payload, for revisits
    too), record_type, refers_to; with ``payloads`` also url and the payload
    (empty for revisits). Every response is held against its digest.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    paths = manifest.select("path").repartition(max(1, min(2000, manifest.count())))
    return paths.mapInArrow(_read(payloads), schema)
