import base64
import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from tallyframe.llm import warc

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: é", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "u", "é" * 70_000),
         (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (None, "n", "<p>one</p>"),
         (8, "P*M\x18\x00\x00\x00\x00", "P*M\x18\x00\x00\x00\x00" * 9), (-3, "u", "solo")]
SCHEMA = "page_id long, url string, html string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"payload": F.lit(1), "refers_to": F.lit("x"), "frame": F.lit(0)})


def plain(rows, least=0):
    top = {}
    for i, _, html in rows:
        top[html or ""] = max((x for x in (top.get(html or ""), i) if x is not None), default=None)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        last = top[html or ""]
        revisit = len(data) >= least and i != last
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, url or "", "revisit" if revisit else "response", None if revisit else data, len(data), digest, last if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.url, r.record_type, bytes(r.payload) if r.payload is not None else None, r.payload_bytes,
                    r.payload_digest, r.refers_to) for r in df.collect()), key=str)


def test_archives_read_back(spark):
    assert rows_of(warc.archive_pages(pages(spark))) == plain(PAGES)


def test_small_payloads_are_never_revisits(spark):
    assert rows_of(warc.archive_pages(pages(spark), min_bytes=11)) == plain(PAGES, 11)


def test_files_are_standard_frames_with_a_leading_dictionary(spark, tmp_path):
    many = [(i, f"http://h/{i}", f"<html><body><p>page number {i} says {'word ' * (i % 9)}</p></body></html>") for i in range(400)]
    path = str(tmp_path / "archives")
    source = pages(spark, many).repartition(3)
    warc.write_archives(warc.mark_revisits(source), path, warc.sample_dictionary(warc._rows(source)))
    files = sorted((tmp_path / "archives").glob("part-*"))
    assert files
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert dictionary.dict_id() != 0
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size:], read_across_frames=True)
        assert stream.read().count(b"WARC/1.1\r\n") == len(list(warc.frames(data)))
    plain_size = sum(len(zstandard.compress(warc.record_bytes(i, u, "response", h.encode(), None), 3)) for i, u, h in many)
    assert sum(f.stat().st_size - 8 - struct.unpack_from("<II", f.read_bytes())[1] for f in files) < 0.8 * plain_size


def test_damage_is_noticed():
    raw = warc.record_bytes(1, "u", "response", b"payload", None)
    assert warc.parse_record(raw)[3] == b"payload"
    try:
        warc.parse_record(raw.replace(b"payload", b"PAYLOAD"))
    except ValueError:
        return
    raise AssertionError("a changed payload was accepted")


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, [])).count() == 0
