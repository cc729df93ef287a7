"""WARC archives: a writer of one gzip member per record, and a reader whose tasks each scan a range of bytes.

A task looks in its range for the gzip magic and takes the first place where a member decodes, begins with a WARC header
and is followed by another member or the end of the file. From there it follows members from end to start, so it owns
exactly the records that start inside its range, however far the last of them reaches beyond.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import collecting, discard, freeze, lookup
from marginalia.shared import scratch_dir

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Bytes of a range that one task reads, and bytes read at a time.
SPLIT, BUFFER = 16 << 20, 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"(?i)\r\ncontent-length: *(\d+)")


def member(record: bytes) -> bytes:
    """The record as a gzip member inside which no other place would pass for a record's start."""
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_HUFFMAN_ONLY), (1, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_FIXED)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
        made = z.compress(record) + z.flush()
        at = made.find(MAGIC, 1)
        while at > 0 and not _header(memoryview(made)[at:]):
            at = made.find(MAGIC, at + 1)
        if at < 0:
            return made
    raise ValueError("a record that looks like an archive at every compression")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record of the response that refers_to names, with the digest and size of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    own = "none" if page_id is None else page_id
    lines = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", "", url or ""), f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(data: bytes | memoryview) -> bytes | None:
    """The WARC header with which the member at the start of data begins; None if it isn't one."""
    return _first_header(data[at : at + BUFFER] for at in range(0, len(data), BUFFER))


def _first_header(parts: Iterable[bytes | memoryview]) -> bytes | None:
    """The same of a member that comes in parts. It is decoded as far as its header's blank line, however long that takes;
    what doesn't begin as a header does is given up at once."""
    z, got = zlib.decompressobj(31), bytearray()
    try:
        for data in parts:
            while len(data) and not z.eof:
                seen = max(0, len(got) - 3)
                got += z.decompress(data, 1 << 16)
                data = z.unconsumed_tail
                if not got.startswith(b"WARC/"[: len(got)]):
                    return None
                end = got.find(b"\r\n\r\n", seen)
                if end >= 0:
                    return bytes(got[:end]) if _LENGTH.search(got[:end]) else None
    except zlib.error:
        pass
    return None


def _parts(f, at: int, size: int) -> Iterator[bytes]:
    """The file from a place on, a little of it first."""
    step = 1 << 14
    while at < size:
        data = f.read_at(min(step, size - at), at)
        if not data:
            return
        yield data
        at, step = at + len(data), BUFFER


def _decode(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The content of the member at a place, and where the next would start; None if it doesn't decode to its end."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= size:
                return None
            data = f.read_at(min(BUFFER, size - pos), pos)
            pos += len(data)
            parts.append(z.decompress(data))
    except zlib.error:
        return None
    return b"".join(parts), pos - len(z.unused_data)


def _starts(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The record that starts at a place, and the next place, if one really does."""
    if _first_header(_parts(f, at, size)) is None:
        return None
    found = _decode(f, at, size)
    if found and (found[1] == size or f.read_at(3, found[1]) == MAGIC):
        return found
    return None


def _is_record(content: bytes) -> bool:
    """Whether what a member holds begins with a WARC header; a member of anything else is passed over."""
    end = content.find(b"\r\n\r\n") if content.startswith(b"WARC/") else -1
    return end >= 0 and _LENGTH.search(content, 0, end) is not None


def _files(uri: str):
    """The file system of a folder or file, and its path there, for tasks, which are outside the JVM: local files, and what
    Arrow was built with. s3a and s3n are Hadoop's names for s3; hdfs needs libhdfs on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def scan(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record that starts in [start, end). What doesn't decode is passed over."""
    at = start
    while at < end:
        data = f.read_at(min(BUFFER, end - at) + 2, at)
        first = data.find(MAGIC)
        if first < 0 or at + first >= end:
            at += max(1, len(data) - 2)
            continue
        at += first
        found = _starts(f, at, size)
        if not found:
            at += 1
            continue
        while found:
            yield at, found[0]
            at = found[1]
            found = _decode(f, at, size) if at < end else None
            if found and not _is_record(found[0]):
                found = None


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of a record, names in lower case, and its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def write(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Writes page_id, url, payload (binary) and refers_to, one file for each partition; the files' paths and sizes.

    Each attempt of a task writes a file of its own, and only the files of attempts that succeeded are returned, so a lost
    executor leaves no half of an archive in the result. The list has one entry for each partition.
    """

    def run(batches):
        import pandas as pd

        where, path = _files(folder)
        where.create_dir(path, recursive=True)
        name, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        with where.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    made = member(record(page_id, url, payload, refers_to))
                    out.write(made)
                    size += len(made)
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame({"path": [folder + name[len(path) :]], "size": [size]}), preserve_index=False)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", F.col("refers_to").cast("long"))
    return [(r.path, r.size) for r in rows.mapInArrow(run, "path string, size long").collect() if r.size]


def read(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """path, offset, page_id, record_type, refers_to, digest (lower-case hex) and payload (null for revisits), and
    payload_bytes as the record's HTTP header states it, of every record, each read by the task in whose range it starts."""

    def run(batches):
        import pyarrow as pa

        names = ["path", "offset", "page_id", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        number = re.compile(r"<urn:page:(-?\d+)>").fullmatch

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for ranges in batches:
            for path, size, start in zip(*(c.to_pylist() for c in ranges.columns)):
                where, own = _files(path)
                rows, held = [], 0
                with where.open_input_file(own) as f:
                    for at, content in scan(f, size, start, min(size, start + split)):
                        fields, block = parse(content)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        ids = [m and int(m[1]) for m in (number(fields.get("warc-record-id", "")), number(fields.get("warc-refers-to", "")))]
                        kind = fields.get("warc-type")
                        length = _LENGTH.search(head)
                        sha1 = base64.b32decode(fields.get("warc-payload-digest", "").partition(":")[2]).hex()
                        rows.append((path, at, ids[0], kind, ids[1], sha1, int(length[1]) if length else None, payload if kind == "response" else None))
                        held += len(content)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "path string, offset long, page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload binary"
    ranges = [(p, s, at) for p, s in files for at in range(0, s, split)]
    if not ranges:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(ranges, "path string, size long, start long").repartition(len(ranges), "path", "start")
    return table.mapInArrow(run, schema)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and refers_to: of pages of equal payloads of at least LEAST_REVISIT bytes, all but those of the
    largest page_id refer to it. A null html is an empty payload; a null page_id counts as smaller than any other, and
    pages of nothing but null ids stay whole; pages that repeat the largest id are each written whole."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    long = own.filter(F.octet_length("payload") >= LEAST_REVISIT)
    groups = long.groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1 and largest is not null")
    groups = freeze(groups, "payload-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = lookup(own, groups, "sha1", "n", max(total, 1))
    old = F.col("largest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")))
    return joined.select("page_id", "url", "payload", F.when(old, F.col("largest")).alias("refers_to"))


def archive(pages: DataFrame, split: int = SPLIT, folder: str | None = None) -> DataFrame:
    """Writes all pages to archives, reads them back and gives a row for each record: page_id, payload_bytes and payload_digest
    (of the full payload: recomputed for responses, as the record states it for revisits), record_type and refers_to. An
    empty table writes nothing and gives an empty one. Archives stay in the folder, if one is named; else they are written to
    the shared one and deleted once they were read."""
    spark = pages.sparkSession
    with collecting() as made:
        files = write(marked(pages), folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
        back = read(spark, files, split).select(
            "page_id",
            F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
            F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"),
            "record_type",
            "refers_to",
        )
        if folder is None:
            back = freeze(back, "records")
    discard(spark, made + [p for p, _ in files if folder is None], keep=(back,) if folder is None else ())
    return back
