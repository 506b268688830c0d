"""WARC archives with a Zstandard dictionary, and reading them.

The dictionary is built from a bounded sample of the records. Each archive starts with a skippable frame (magic 0x184D2A5D)
that holds the dictionary; every record follows as a frame of its own, so that one can be read without the others. Of records
with equal payloads one is a response, the others are revisits that name it and carry no payload.

Which record is the response is settled by a grouped maximum over digests, joined back; Spark splits a hot digest. A task
writes its records to a file named after its partition, under a temporary name first, so that a retried or doubled task
leaves one whole file. Files go to the shared folder by its URI.

Edge cases: a null html is an empty payload; a null page id or url is written as such; repeated rows with the largest id and
equal payloads are all the response; a payload shorter than min_payload is always a response; an empty table writes no archive
and reads as no row; other columns are ignored; a record is held whole by its task, so memory follows the longest page.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, cut, kept_table

MAGIC = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 1 << 14, 1 << 16
LEVEL = 3
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest.hex()}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. WARC-Page-ID, WARC-Payload-Length and WARC-Refers-To-Page-ID are extension fields."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    at = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:at].decode().split("\r\n")[1:])
    block = data[at + 4 : at + 4 + int(fields["Content-Length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def verified(fields: dict[str, str], payload: bytes) -> tuple[int, str]:
    """Length and SHA-1 (base 32) of a record's payload, held against its header; a revisit has no payload and keeps its header's."""
    told = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return told
    found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != told:
        raise ValueError(f"the payload of a record has {found}, its header says {told}")
    return found


def train_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from sample records; empty if they are too few or too alike for one."""
    import zstandard

    if len(records) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def typed(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), refers_to and revisit of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("bytes"))
    same = digests.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = kept_table(same.filter("n > 1").select("digest", "last"))  # a table of known size: Spark broadcasts it while it is small, and payloads stay where they are
    joined = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(repeated, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below folder, a URI that all executors share; returns path, records and bytes."""
    bounded_batches(pages.sparkSession)
    rows = typed(pages, min_payload)
    chosen = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS).distinct()  # ids alone, so that tasks send little
    sampled = pages.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).join(F.broadcast(chosen), "page_id")
    picked = sampled.groupBy("page_id").agg(F.min(F.struct(F.xxhash64("url", "html"), "url", "html")).alias("first")).select("page_id", "first.url", "first.html").orderBy("page_id")
    dictionary = train_dictionary([
        build_record(r.page_id, r.url, (r.html or "").encode(), hashlib.sha1((r.html or "").encode()).digest(), None, False) for r in picked.collect()
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        target, part = f"{root}/part-{task.partitionId():05d}.warc.zst", f"{root}/.part-{task.partitionId():05d}-{uuid.uuid4().hex}"
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        records = written = 0
        sink = None
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(part, compression=None)
                    sink.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                payload = html.encode()
                frame = packer.compress(build_record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to, revisit))
                sink.write(frame)
                records, written = records + 1, written + len(frame)
        if sink is not None:
            sink.close()
            store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([records], pa.int64()), pa.array([written], pa.int64())], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_frames(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time; the dictionary comes from the archive's first frame."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    held = stream.read(size)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    rest, more = b"", True
    while rest or more:
        if not rest:
            rest = stream.read(chunk)
            more = bool(rest)
            continue
        frame, parts = opener.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of archives (path): the fields of its header, and its payload if asked for. Archives are read by as many tasks."""
    bounded_batches(spark)
    schema = FIELDS if payloads else FIELDS.rpartition(",")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[list] = [[] for _ in schema.split(",")]
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_frames(stream):
                        fields, payload = parse_record(record)
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        values = [number("WARC-Page-ID"), *verified(fields, payload), fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), payload]
                        for column, value in zip(rows, values, strict=False):
                            column.append(value)
                        if len(rows[0]) >= 512:
                            yield laid_out(rows)
                            rows = [[] for _ in rows]
                if rows[0]:
                    yield laid_out(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in schema.split(",")]

    def laid_out(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names=names)

    paths = [r.path for r in archives.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return listed.mapInArrow(run, schema)
