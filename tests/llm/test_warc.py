"""Archives against the pages they were made from."""

import base64
import hashlib
import io
import random
import struct

import zstandard

from certus.llm import warc
from certus.llm.common import scratch
from certus.llm.warc import SKIPPABLE, ArchiveWriter, page_record, parsed, read_archives, read_records, write_archives

SCHEMA = "page_id long, url string, html string, path string"


def pages():
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", "<p>" + " ".join(r.choice(["alpha", "beta", "é", "\r\n\r\n"]) for _ in range(r.randrange(400))), "p") for i in range(300)]
    rows += [(300 + i, None if i % 2 else "http://x/ a\nb", rows[i % 7][2], "q") for i in range(50)]
    rows += [(400, "u", None, ""), (401, "u", "", ""), (402, "u", "z" * 3_000_000, ""), (5, "again", rows[5][2], ""), (None, "u", rows[9][2], ""), (None, "u", "only here", "")]
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        other = first.get(html or "") if len(data) >= least else None
        seen = other is not None and other != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if seen else "response", other if seen else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    rows = pages()
    for least in (0, 200):
        manifest = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch(spark, "warc"), least)
        assert sorted(map(tuple, read_archives(manifest).collect()), key=str) == expected(rows, least)
    texts = {html or "" for _, _, html, _ in rows}
    got = read_archives(manifest, True).where("record_type = 'response'").collect()
    assert {bytes(x.payload).decode() for x in got} == texts


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame(pages()[:3], SCHEMA)
    assert read_archives(write_archives(docs.limit(0), scratch(spark, "warc"))).count() == 0
    got = read_archives(write_archives(docs.unionAll(docs), scratch(spark, "warc"))).collect()
    assert len(got) == 6 and {x.record_type for x in got} == {"response"}


def test_archive_layout(monkeypatch):
    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    rows, stream = pages()[:300], Kept()
    writer = ArchiveWriter(stream)
    for i, url, html, _ in rows:
        writer.add(page_record(i, url, html.encode(), None))
    writer.close()
    magic, size = struct.unpack("<II", stream.data[:8])
    assert magic == SKIPPABLE and size
    held = zstandard.ZstdCompressionDict(stream.data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(stream.data[8 + size :])
    assert parsed(first)[0]["warc-record-id"] == "<urn:x-page:0>"
    assert [parsed(x)[1].partition(b"\r\n\r\n")[2].decode() for x in read_records(io.BytesIO(stream.data))] == [r[2] for r in rows]


def test_bounded_archives(spark, monkeypatch):
    manifest = write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(1), scratch(spark, "warc"))
    assert manifest.count() >= 1 and all(x.bytes < warc.ARCHIVE_BYTES + 4_000_000 for x in manifest.collect())
