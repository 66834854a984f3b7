"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Archives are written by Spark's tasks into a folder that all machines share, each file bounded in
size, and read back through Spark's ``binaryFile`` source.  A payload that occurs more than once is
stored once, as the response of the largest page id; the others are revisits that refer to it.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolock.llm.common import require, shared_folder

# Fixed values of the formats: the magic of the dictionary's skippable frame, of zstd frames and of
# dictionaries, and the profile of a revisit by payload digest.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Bytes of records after which a task begins another file, and bytes that a reader decodes at a time.
FILE_BYTES = 8 << 20
STEP = 4 << 10
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class BadArchive(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of page ``refers_to`` (its block has the HTTP header alone)."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-ID": "" if page_id is None else str(page_id), "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v != "" or k == "WARC-Target-URI").encode() + b"\r\n" + block + b"\r\n\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; raises :class:`BadArchive`."""
    at, dictionary = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", raw, 4)[0]
        at = 8 + size
        if at > len(raw):
            raise BadArchive("the dictionary's frame is cut off")
        held = raw[8:at]
        if held[:4] == FRAME:
            held = zstandard.ZstdDecompressor().decompress(held)
        if held[:4] != DICTIONARY:
            raise BadArchive("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(held)
    decode = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(raw)
    while at < len(raw):
        magic = raw[at : at + 4]
        if len(magic) == 4 and 0x184D2A50 <= struct.unpack("<I", magic)[0] <= 0x184D2A5F:
            if at + 8 > len(raw):
                raise BadArchive("a skippable frame is cut off")
            at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            continue
        if magic != FRAME:
            raise BadArchive(f"no frame begins at byte {at}")
        one, parts, end = decode.decompressobj(), [], at
        while not one.eof:  # in steps: what a step reads beyond the frame is copied
            if end >= len(raw):
                raise BadArchive(f"the frame at byte {at} is cut off")
            try:
                parts.append(one.decompress(view[end : end + STEP]))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at byte {at} can't be decoded: {e}") from e
            end = min(end + STEP, len(raw))
        at = end - len(one.unused_data)
        yield b"".join(parts)


def parse_record(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header (names in lower case) and block of a record, checked against each other."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("a record has no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise BadArchive(f"a header line is no field: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if lacking := [n for n in NEEDED if n not in fields]:
        raise BadArchive(f"a record lacks {lacking}")
    if not fields["content-length"].isdecimal():
        raise BadArchive("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"a block has {len(rest) - 4} bytes; Content-Length is {size}")
    return fields, rest[:size]


def read_page(text: bytes) -> tuple:
    """page id, URL, bytes of the payload, digest, type and page referred to, after validation."""
    fields, block = parse_record(text)
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+) *\r?$", http)
    if not gap or not http.startswith(b"HTTP/1.") or not length:
        raise BadArchive("a block has no HTTP header with its length")
    size, kind = int(length[1]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size:
            raise BadArchive(f"a payload has {len(payload)} bytes; its header says {size}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise BadArchive("a payload doesn't have its digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise BadArchive("a revisit has a payload, or refers to nothing")
    else:
        raise BadArchive(f"unexpected type {kind}")
    number = lambda n: int(fields[n]) if n in fields else None
    return number("warc-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("warc-refers-to-page-id")


def train(pages: DataFrame, sample_rows: int = 256, size: int = 32 << 10) -> bytes:
    """A dictionary from ``sample_rows`` payloads at most, 4096 characters of each; it changes sizes only,
    never what is read back.  Few or uniform samples give a dictionary of their raw bytes."""
    cut = F.substring(F.coalesce("html", F.lit("")), 1, 4 << 10)  # 16 KB each at most
    held = [r.html.encode() for r in pages.select(cut.alias("html")).limit(sample_rows).collect()]
    held = [h for h in held if h] or [b"<!DOCTYPE html><html><head></head><body></body></html>"]
    try:
        return zstandard.train_dictionary(size, held, level=3).as_bytes()
    except zstandard.ZstdError:
        return zstandard.train_dictionary(1 << 10, [b"%d %s" % (i * 7919, h[:512]) for i in range(64) for h in held[:16]]).as_bytes()


def write_archives(pages: DataFrame, folder: str, level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``: a row for each file, with its records.

    A task's rows are sorted, so one that runs again, on another machine too, writes the same records to
    files of the same names; a file appears under its name when it is whole, and one that is there
    already stays.
    """
    require(pages, ("page_id", "url", "html"), "pages")
    spark = pages.sparkSession
    dictionary = train(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    largest = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha")).groupBy("sha").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("copies"))
    copies = largest.where("copies > 1 and kept_id is not null").select("sha", "kept_id")
    plan = rows.join(copies, "sha", "left").select("page_id", "url", "payload", "sha", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept_id")), F.col("kept_id")).alias("refers_to"))
    plan = plan.sortWithinPartitions("sha", F.desc("page_id"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = FileSystem.from_uri(folder)
        encode = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        held, size, records, done = [], 0, 0, 0
        lead = leading_frame(dictionary)

        def flush() -> pa.RecordBatch:
            nonlocal held, size, records, done
            name = f"part-{context.partitionId():05d}-{done:04d}.warc.zst"
            draft = f"{base}/.{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(draft) as f:
                f.write(lead)
                for x in held:
                    f.write(x)
            try:
                fs.move(draft, f"{base}/{name}")
            except OSError:  # some stores keep what is there: the same records from another attempt
                if fs.get_file_info(f"{base}/{name}").type != FileType.File:
                    raise
                fs.delete_file(draft)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])
            held, size, records, done = [], 0, 0, done + 1
            return out

        for b in batches:
            for page, url, payload, sha, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                held.append(encode.compress(record(page, url, payload, digest, refers)))
                size += len(held[-1])
                records += 1
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    return plan.mapInArrow(run, "file string, records long")


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in ``folder``, validated; any folder that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for raw in b.column(0):
                rows = [read_page(x) for x in read_archive(raw.as_py())]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, PAGE)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and read the archives back.

    Null html is an empty payload; a null url an empty URI.  Rows that repeat the largest page id of
    a payload are all responses; a row without a page id is a revisit if its payload has an id.  An
    empty table gives no rows.  A page of any length is one
    record.  Raises unless as many records were written as there are pages.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder).agg(F.sum("records")).first()[0] or 0
    if written != pages.count():
        raise BadArchive(f"{written} records were written for {pages.count()} pages")
    if not written:
        return spark.createDataFrame([], PAGE)
    return read_archives(spark, folder)
