import base64
import hashlib
import io
import struct

import pyarrow.fs
import pytest
import zstandard

from brindle.llm import warc
from brindle.llm.queries import OP2_SQL, op2_warc


def test_query_equals_sql(spark, llm_dir, same_rows):
    same_rows(op2_warc(spark, llm_dir), OP2_SQL)


def archive(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/out"
    written = warc.write_archives(pages.repartition(2), folder, **options)
    return written, warc.read_archives(spark, written, folder, payloads=True).collect()


def test_round_trip_of_odd_pages(spark, tmp_path):
    big = "<p>é</p>" * 200_000
    rows = [(i, f"http://x/{i}", f"<html>{i} " + "common words " * 20, 0) for i in range(40)]
    rows += [(50, None, None, 0), (51, "http://x/51", "", 0), (52, "http://x/52", big, 0), (53, "bad\r\nurl", big, 0), (None, "http://x/n", big, 0), (3, "http://x/3", rows[3][2], 0)]
    written, got = archive(spark, tmp_path, rows)
    assert sum(r.records for r in written.collect()) == len(rows) == len(got)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        payload = html[r.page_id]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[50] == ("revisit", 51) and kinds[51] == ("response", None)
    assert kinds[52] == ("revisit", 53) and kinds[53] == ("response", None) and kinds[None] == ("revisit", 53)
    assert kinds[3] == ("response", None)


def test_archives_hold_a_dictionary_and_single_records(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><body class='main'>page number {i * 7919}</body></html>", 0) for i in range(60)]
    written, _ = archive(spark, tmp_path, rows)
    for r in written.collect():
        data = open(r.path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size > 0
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        first = opener.decompressobj().decompress(data[8 + size :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_short_payloads_stay_responses(spark, tmp_path):
    _, got = archive(spark, tmp_path, [(1, "a", "xy", 0), (2, "b", "xy", 0), (3, "c", "xyz", 0), (4, "d", "xyz", 0)], min_payload=3)
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_and_broken_archives(spark, tmp_path):
    _, got = archive(spark, tmp_path, [])
    assert got == []
    with pytest.raises(ValueError):
        list(warc.read_frames(pyarrow.fs.LocalFileSystem().open_input_stream(__file__)))
    record = warc.build_record(7, "u", b"x" * 100, b"\0" * 20, None, False)
    whole = struct.pack("<II", warc.MAGIC, 0) + zstandard.ZstdCompressor().compress(record)
    assert list(warc.read_frames(io.BytesIO(whole))) == [record]
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(whole[:-5])))


def test_a_damaged_payload_is_no_row(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some payload")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    written = warc.write_archives(pages.coalesce(1), folder)
    assert warc.read_archives(spark, written, folder).first().payload_bytes == 12
    for damaged in (b"some pAyload", b"some payloa"):
        record = warc.build_record(1, "u", damaged, hashlib.sha1(b"some payload").digest(), None, False)
        with open(written.first().path, "wb") as out:
            out.write(struct.pack("<II", warc.MAGIC, 0) + zstandard.ZstdCompressor().compress(record))
        with pytest.raises(Exception, match="its header says"):
            warc.read_archives(spark, written, folder).collect()
