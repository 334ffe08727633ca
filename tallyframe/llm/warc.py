"""WARC archives compressed record by record with one Zstandard dictionary.

The dictionary is built from a bounded sample of the records (about
``SAMPLE_RECORDS`` of them, chosen by the hash of the id, and never more than twice
as many; ``SAMPLE_BYTES`` of each); it only helps compression. Every archive begins with a skippable frame that holds it, and every
record is a frame of its own. Archives are written by Spark's own file writer: a
line is a frame and the line separator is an empty skippable frame, which every
Zstandard reader passes over. So archives reach any file system that Spark
reaches, and lost tasks are written again.

Of the records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest id is a response and the others are revisits of it.

Defined results: null payloads and urls count as empty; rows that share the
largest id of equal payloads are all responses; a null id sorts below all others;
other columns are ignored; an empty table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import shared_dir

SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 1 << 15
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Frame magics of the Zstandard and WARC-Zstandard formats.
_FRAME, _SKIPPABLE, _DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_EMPTY_FRAME = struct.pack("<II", _SKIPPABLE, 0)
_DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str, kind: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url.encode('unicode_escape').decode()}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, type, payload, payload bytes, digest, refers_to) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(v) if (v := fields[name][len("<urn:page:"):-1]) else None
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (number("WARC-Record-ID"), fields["WARC-Target-URI"].encode().decode("unicode_escape"), fields["WARC-Type"],
            None if revisit else payload, size, digest, number("WARC-Refers-To") if revisit else None)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; plain sample content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=256, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _frame_end(data: memoryview, at: int) -> int:
    """End of the frame that starts at ``at``: its blocks say how long they are."""
    descriptor = data[at + 4]
    end = at + zstandard.frame_header_size(data[at:at + 18])
    while True:
        block = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return end + (4 if descriptor & 4 else 0)


def frames(archive: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive."""
    data, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == _FRAME:
            end = _frame_end(data, at)
            yield reader.decompress(data[at:end])
        else:
            end = at + 8 + size
            if magic == _DICTIONARY and at == 0:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:end])))
        at = end


def _rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is set for revisits.

    Payloads are compared by SHA-256; the largest id of each is a partial
    aggregate, so a payload that a third of all pages share does not gather.
    """
    rows = _rows(pages, id_col, url_col, payload_col).withColumn("_same", F.sha2("payload", 256))
    last = (rows.select("page_id", "_same").groupBy("_same")
            .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.join(last, "_same", "left").select("page_id", "url", "payload", F.when(revisit, F.col("_last")).alias("refers_to"))


def sample_dictionary(pages: DataFrame) -> bytes:
    """A dictionary for (page_id, url, payload) rows."""
    share = min(1.0, SAMPLE_RECORDS / max(1, pages.count()))
    chosen = F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)), F.lit(False))
    rows = (pages.where(chosen | F.lit(share == 1.0)).select(F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "page_id", "url")
            .limit(2 * SAMPLE_RECORDS).collect())
    return train_dictionary([record_bytes(r.page_id, r.url, "response", bytes(r.payload), None) for r in rows])


def write_archives(records: DataFrame, path: str, dictionary: bytes) -> None:
    """Writes (page_id, url, payload, refers_to) rows as archives under ``path``, one per task."""
    def compress(batches) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        lead = [struct.pack("<II", _DICTIONARY, len(dictionary)) + dictionary]
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            out = [writer.compress(record_bytes(i, u, "response" if r is None else "revisit", p, r)) for i, u, p, r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(lead + out, pa.binary())], ["frame"])
            lead = []

    framed = records.mapInArrow(compress, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", _EMPTY_FRAME.decode()).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; the digest of every payload is checked."""
    def parse(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [parse_record(raw) for raw in frames(content.as_py())]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     [f.split()[0] for f in RECORD.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes every page as a record and returns what the archives hold."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(mark_revisits(pages, min_bytes=min_bytes), path, sample_dictionary(_rows(pages)))
    return read_archives(spark, path)
