import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.sources import edf, files
from brindle.sources.edf import EdfSource
from brindle.streaming import ingest


def write_edf(path, channels, records):
    """channels: name to samples per record; one second a record; values k * 10 + channel."""
    ns = len(channels)
    head = f"{'0':<8}{'x':<80}{'y':<80}01.02.2303.04.05{256 * (ns + 1):<8}{'':<44}{records:<8}{1:<8}{ns:<4}"
    fields = [[f"{c:<16}" for c in channels], [" " * 80] * ns, [f"{'uV':<8}"] * ns, [f"{-3276.8:<8}"] * ns, [f"{3276.7:<8}"] * ns, [f"{-32768:<8}"] * ns, [f"{32767:<8}"] * ns, [" " * 80] * ns, [f"{n:<8}" for n in channels.values()], [" " * 32] * ns]
    body = b"".join(struct.pack("<h", (r * n + k) * 10 + c) for r in range(records) for c, n in enumerate(channels.values()) for k in range(n))
    path.write_bytes((head + "".join(map("".join, fields))).encode("latin-1") + body)


def test_edf_metadata_and_samples(spark, tmp_path):
    write_edf(tmp_path / "a-123-456.edf", {"EEG F3": 4, "EEG FP1": 4}, 5)
    spark.dataSource.register(EdfSource)
    meta = spark.read.format("edf").option("what", "recordings").load(str(tmp_path)).first()
    assert (meta.number_of_signals, meta.sampling_frequency, meta.n_samples, meta.duration_sec) == (2, 4.0, 20, 4.75)
    assert meta.signal_labels == ["EEG F3", "EEG FP1"] and meta.start_date.year == 2023
    x = spark.read.format("edf").option("what", "samples").option("rangeBytes", "400").load(str(tmp_path))
    got = {(r.channel, r.n): r.x for r in x.collect()}
    assert len(got) == 40 and abs(got["EEG FP1", 7] - 7.1) < 1e-6 and abs(got["EEG F3", 19] - 19.0) < 1e-6


def test_edf_reads_only_what_is_asked(spark, tmp_path):
    """One channel of nine is read by itself; options choose files, channels and records before reading."""
    write_edf(tmp_path / "a.edf", {f"c{k}": 4 for k in range(9)}, 50)
    write_edf(tmp_path / "b.edf", {"c1": 4, "c2": 8}, 3)
    h = edf.read_header(str(tmp_path / "a.edf"))

    class Counting:
        def __init__(self, path):
            self.f, self.bytes = open(path, "rb"), 0  # noqa: SIM115

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            self.bytes += n
            return self.f.read(n)

    f = Counting(tmp_path / "a.edf")
    got = edf.read_records(f, h, 10, 30, [5])
    assert f.bytes == 20 * 4 * 2 and got[5][0].tolist() == [(10 * 4 + k) * 10 + 5 for k in range(4)]
    f = Counting(tmp_path / "a.edf")
    assert edf.read_records(f, h, 0, 50, list(range(9)))[8].shape == (50, 4) and f.bytes == 50 * 36 * 2
    spark.dataSource.register(EdfSource)
    source = spark.read.format("edf").option("what", "samples")
    asked = source.option("files", "a.edf").option("channels", "c3|c4").option("from", "101").option("to", "107").load(str(tmp_path))
    assert sorted((r.channel, r.n) for r in asked.collect()) == [(c, n) for c in ("c3", "c4") for n in range(101, 107)]
    reader = edf._Reader({"what": "samples", "path": str(tmp_path), "files": "a.edf", "channels": "c3", "from": "100", "to": "108"})
    assert len(reader.partitions()) == 1 and sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 8
    x = spark.read.format("edf").option("what", "samples").load(str(tmp_path))
    assert x.filter("channel = 'c2'").count() == 4 * 50 + 8 * 3 and x.count() == 9 * 4 * 50 + 12 * 3


def test_edf_annotations_and_filters(spark, tmp_path):
    marks = [b"+0\x14\x14\x00+1.5\x150.25\x14eyes open\x14\x00", b"+1\x14\x14\x00", b"+2\x14\x14\x00+2.5\x14spike\x14sharp\x14\x00"]
    labels, samples, notes = ["EEG F3", "EEG F4", "EDF Annotations"], [2, 2, 30], ["HP:0.1Hz LP:75Hz", "HP:0.5Hz LP:70Hz N:50Hz", ""]
    head = f"{'0':<8}{'x':<80}{'y':<80}01.02.2303.04.05{256 * 4:<8}{'EDF+C':<44}{-1:<8}{1:<8}{3:<4}"
    fields = [[f"{c:<16}" for c in labels], [" " * 80] * 3, [f"{'uV':<8}"] * 3, [f"{-1:<8}"] * 3, [f"{1:<8}"] * 3, [f"{-32768:<8}"] * 3, [f"{32767:<8}"] * 3, [f"{c:<80}" for c in notes], [f"{n:<8}" for n in samples], [" " * 32] * 3]
    body = b"".join(struct.pack("<4h", 1, 2, 3, 4) + m.ljust(60, b"\x00") for m in marks)
    (tmp_path / "p.edf").write_bytes((head + "".join(map("".join, fields))).encode("latin-1") + body)
    spark.dataSource.register(EdfSource)
    load = lambda what: spark.read.format("edf").option("what", what).option("rangeBytes", "500").load(str(tmp_path))
    assert sorted(map(tuple, load("annotations").collect())) == [("p.edf", 1.5, 0.25, "eyes open"), ("p.edf", 2.5, None, "sharp"), ("p.edf", 2.5, None, "spike")]
    r = load("recordings").first()
    assert (r.number_of_signals, r.signal_labels, r.highpass, r.lowpass, r.annotations, r.n_samples, r.bad_channels) == (2, ["EEG F3", "EEG F4"], 0.5, 70.0, "eyes open; spike; sharp", 6, [])
    assert load("samples").select("channel").distinct().count() == 2 and load("samples").count() == 12


def test_edf_round_trip_and_failed_tasks(spark, tmp_path):
    """What is written is read again within half a step of 16 bits; a failing task leaves no file, not even a temporary one."""
    rng = np.random.default_rng(1)
    signals = {(f"r{k}.edf", c): rng.standard_normal(n).cumsum() for k, n in enumerate((40, 64)) for c in ("EEG F3", "EEG F4")}
    rows = [(f, c, at // 8, at, x[at : at + 8].tolist()) for (f, c), x in signals.items() for at in range(0, len(x), 8)]
    made = edf.records(spark.createDataFrame(rows, "file_name string, channel string, block long, start long, signal array<double>").repartition(5), "file_name", "channel")
    spark.dataSource.register(EdfSource)
    (tmp_path / "out").mkdir()
    made.write.format("edf").option("recordSeconds", "0.5").option("start", "2024-03-01 10:20:30").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["r0.edf", "r1.edf"]
    got = {(r.file_name, r.channel, r.n): r.x for r in spark.read.format("edf").option("what", "samples").load(str(tmp_path / "out")).collect()}
    assert len(got) == 2 * (40 + 64)
    for (f, c), x in signals.items():
        top = max(np.abs(v).max() for (g, _), v in signals.items() if g == f)
        assert np.allclose([got[f, c, n] for n in range(len(x))], x, atol=top / 32767 * 0.51 + 1e-6)
    meta = spark.read.format("edf").load(str(tmp_path / "out")).filter("file_name = 'r1.edf'").first()
    assert (meta.sampling_frequency, meta.n_samples, str(meta.start_date)) == (16.0, 64, "2024-03-01 10:20:30")
    broken = made.withColumn("record", F.when(F.col("file_name") == "r1.edf", F.col("record") * 2).otherwise(F.col("record")))
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception, match="does not follow"):
        broken.write.format("edf").mode("append").save(str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/123-456.edf").write_bytes(b"x" * 200)
    (tmp_path / "small.edf").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x" * 500)
    got = files.with_patient(files.inventory(spark, str(tmp_path), ".edf", 100)).collect()
    assert [(r.file_name, r["size"], r.patient_number) for r in got] == [("123-456.edf", 200, "456")]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n5,6\n")
    (tmp_path / "empty.csv").write_text("\n")
    got = files.csv_union(spark, str(tmp_path))
    assert got.columns[0] == "csv_file_name"
    assert sorted((r.csv_file_name, r.x, r.y, r.z) for r in got.collect() if r.x is None) == [("b.csv", None, "3", "4"), ("b.csv", None, "5", "6")]
    assert got.count() == 3
    (tmp_path / "c.csv").write_text("y,w\n7.5,north\n")
    typed = files.csv_union(spark, str(tmp_path), typed=True)
    assert dict(typed.dtypes) == {"csv_file_name": "string", "x": "double", "y": "double", "z": "double", "w": "string"} and typed.filter("y = 7.5").first().w == "north"


def test_dictionary_and_sheets(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"age": "years", "x (y)": "odd"}))
    names = files.dictionary(spark, str(tmp_path / "d.json"))
    df = spark.createDataFrame([("age",), ("none",)], "name string")
    assert {r.name: r.description for r in files.described(df, names, "name").collect()} == {"age": "years", "none": None}
    files.write_sheets({"one": df}, f"{tmp_path}/sheets")
    files.write_sheets({"one": df.limit(0)}, f"{tmp_path}/sheets")
    assert files.read_sheet(spark, f"{tmp_path}/sheets", "one").count() == 2


def test_ingest_resumes(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: ingest.ingest_new(spark, source, "id long", target, f"{tmp_path}/cp", lambda s: s.filter("id % 2 = 0")).awaitTermination()
    spark.range(10).write.parquet(source)
    run()
    run()
    assert spark.read.parquet(target).count() == 5
    spark.range(10, 14).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8, 10, 12]
    left = ingest.unprocessed(spark.range(5), spark.createDataFrame([(1,), (1,)], "id long"), "id")
    assert sorted(r.id for r in left.select(F.col("id")).collect()) == [0, 2, 3, 4]
