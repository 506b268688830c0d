"""European Data Format recordings as a Spark data source and sink.

spark.dataSource.register(EdfSource), then spark.read.format("edf").option("what", "recordings", "samples" or "annotations").load(path).
The path is a file or a folder that every executor can open (a mounted store). The driver lists files and their sizes only;
headers are read in tasks. A task reads the records of one range of a file (``rangeBytes`` each, 32 MB unless given) as Arrow
batches. The options ``files`` and ``channels`` (names separated by "|"), ``from`` and ``to`` (numbers of samples, the latter not
included) choose files, channels and records before anything is read. They are options and not pushed filters, because Spark
keeps a Python reader with its filters for all later queries on the same DataFrame.

Writing: records(...).write.format("edf").mode("append").save(folder). A recording is written by one task, record by record, to a
temporary file; the files get their names when all tasks have ended, and none is left if one fails.
"""

from __future__ import annotations

import datetime
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RECORDINGS = (
    "file_path string, size long, file_name string, start_date timestamp, duration_sec double, duration_min double, number_of_signals int,"
    " signal_labels array<string>, sampling_frequency double, highpass double, lowpass double, annotations string, n_samples long, bad_channels array<string>"
)
SAMPLES = "file_name string, channel string, n long, x double"
ANNOTATIONS = "file_name string, onset double, duration double, text string"
_SCHEMAS = {"recordings": RECORDINGS, "samples": SAMPLES, "annotations": ANNOTATIONS}
#: The label of a signal whose samples are annotations; samples that a batch holds at most.
MARKS, TOGETHER = "EDF Annotations", 1 << 18
_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32))


@dataclass
class Header:
    """What the header of a file says; places holds each signal's samples before it in a record."""

    start: datetime.datetime
    offset: int
    records: int
    seconds: float
    labels: list[str]
    samples: list[int]
    scale: list[tuple[float, float, float, float]]
    filters: list[str]

    @property
    def places(self) -> list[int]:
        return [sum(self.samples[:k]) for k in range(len(self.samples))]

    @property
    def width(self) -> int:
        return sum(self.samples)

    def signals(self) -> list[int]:
        """The numbers of the signals that are not annotations."""
        return [k for k, c in enumerate(self.labels) if c != MARKS]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        main = f.read(256).decode("latin-1")
        ns = int(main[252:256])
        rest = f.read(ns * 256).decode("latin-1")
    columns, at = {}, 0
    for name, width in _FIELDS:
        columns[name] = [rest[at + i * width : at + (i + 1) * width].strip() for i in range(ns)]
        at += ns * width
    day, clock = main[168:176].split("."), main[176:184].split(".")
    year = int(day[2]) + (1900 if int(day[2]) >= 85 else 2000)
    offset, samples = int(main[184:192]), [int(v) for v in columns["samples"]]
    records = int(main[236:244])
    if records < 0:  # not known when the header was written
        records = max(0, os.path.getsize(path) - offset) // max(1, 2 * sum(samples))
    scale = [tuple(map(float, v)) for v in zip(*(columns[c] for c in ("pmin", "pmax", "dmin", "dmax")), strict=True)]
    return Header(datetime.datetime(year, int(day[1]), int(day[0]), *map(int, clock)), offset, records, float(main[244:252]), columns["label"], samples, scale, columns["filter"])


def cutoffs(filters: list[str], rate: float) -> tuple[float, float]:
    """High-pass and low-pass in hertz from notes such as "HP:0.1Hz LP:75Hz": the highest and the lowest; 0 and half the rate without one."""
    found = lambda name: [float(v) for f in filters for v in re.findall(rf"{name}\s*:\s*([0-9.]+)", f, re.IGNORECASE)]
    return max(found("HP"), default=0.0), min(found("LP"), default=rate / 2)


def read_records(f, h: Header, first: int, stop: int, wanted: list[int]) -> dict[int, object]:
    """Raw samples (records by samples, 16 bits) of the wanted signals; where they are less than half of a record, only they are read."""
    import numpy as np

    if 2 * sum(h.samples[k] for k in wanted) < h.width:
        parts: dict[int, list] = {k: [] for k in wanted}
        for r in range(first, stop):
            for k in wanted:
                f.seek(h.offset + 2 * (h.width * r + h.places[k]))
                parts[k].append(f.read(2 * h.samples[k]))
        return {k: np.frombuffer(b"".join(p), "<i2").reshape(-1, h.samples[k]) for k, p in parts.items()}
    f.seek(h.offset + 2 * h.width * first)
    block = np.frombuffer(f.read(2 * h.width * (stop - first)), "<i2").reshape(-1, h.width)
    return {k: block[:, h.places[k] : h.places[k] + h.samples[k]] for k in wanted}


def parse_marks(data: bytes) -> list[tuple[float, float | None, str]]:
    """Onset, duration and text of the annotations in one record's bytes; the empty ones that keep time are left out."""
    out = []
    for entry in data.split(b"\x00"):
        time, *texts = entry.split(b"\x14")
        onset, _, length = time.partition(b"\x15")
        if onset[:1] in (b"+", b"-"):
            out += [(float(onset), float(length) if length else None, t.decode("utf-8", "replace")) for t in texts if t]
    return out


@dataclass
class _Range(InputPartition):
    path: str
    part: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}  # Spark hands them over so
        self.what, self.root, self.size = options.get("what", "recordings"), options["path"].removeprefix("file://"), int(options.get("rangebytes", 32 << 20))
        self.chosen = {name: set(options[name].split("|")) for name in ("files", "channels") if name in options}
        self.low, self.high = int(options.get("from", 0)), int(options["to"]) if "to" in options else None

    def partitions(self) -> list[_Range]:
        files = [self.root]
        if os.path.isdir(self.root):
            files = sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.lower().endswith(".edf"))
        if "files" in self.chosen:
            files = [p for p in files if os.path.basename(p) in self.chosen["files"]]
        parts = lambda p: 1 if self.what == "recordings" else max(1, -(-os.path.getsize(p) // self.size))
        return [_Range(p, k, n) for p in files for n in [parts(p)] for k in range(n)]

    def marks(self, path: str, h: Header, first: int, stop: int) -> list[tuple[float, float | None, str]]:
        own = [k for k, c in enumerate(h.labels) if c == MARKS]
        out: list[tuple[float, float | None, str]] = []
        with open(path, "rb") as f:
            for r in range(first, stop) if own else ():
                for rows in read_records(f, h, r, r + 1, own).values():
                    out += parse_marks(rows.tobytes())
        return out

    def read(self, part: _Range):
        import pyarrow as pa

        h, name = read_header(part.path), os.path.basename(part.path)
        first, stop = (h.records * k // part.parts for k in (part.part, part.part + 1))
        if self.what == "recordings":
            labels = [h.labels[k] for k in h.signals()]
            most = max((h.samples[k] for k in h.signals()), default=0)
            n, rate = h.records * most, most / h.seconds if h.seconds else 0.0
            last = (n - 1) / rate if n and rate else 0.0
            texts = [t for *_, t in self.marks(part.path, h, 0, h.records)]
            high, low = cutoffs([h.filters[k] for k in h.signals()], rate)
            yield (part.path, os.path.getsize(part.path), name, h.start, last, last / 60, len(labels), labels, rate, high, low, "; ".join(texts) or None, n, [])
            return
        if self.what == "annotations":
            for onset, length, text in self.marks(part.path, h, first, stop):
                yield (name, onset, length, text)
            return
        yield from self.samples(part, h, name, first, stop, pa)

    def samples(self, part: _Range, h: Header, name: str, first: int, stop: int, pa) -> Iterator:
        import numpy as np

        wanted = [k for k in h.signals() if "channels" not in self.chosen or h.labels[k] in self.chosen["channels"]]
        counts = [h.samples[k] for k in wanted if h.samples[k]]
        if not counts:
            return
        low = max(first, self.low // max(counts))
        high = stop if self.high is None else min(stop, -(-self.high // min(counts)))
        step = max(1, TOGETHER // sum(counts))
        with open(part.path, "rb") as f:
            for at in range(low, high, step):
                end = min(at + step, high)
                for k, rows in read_records(f, h, at, end, wanted).items():
                    pmin, pmax, dmin, dmax = h.scale[k]
                    x = (rows.reshape(-1) - dmin) * (pmax - pmin) / (dmax - dmin) + pmin
                    n = np.arange(len(x)) + at * h.samples[k]
                    asked = (n >= self.low) & (n < (self.high if self.high is not None else n.size + at * h.samples[k]))
                    n, x = n[asked], x[asked]
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(x)), pa.repeat(h.labels[k], len(x)), pa.array(n, pa.int64()), pa.array(x)], names=["file_name", "channel", "n", "x"])


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"].removeprefix("file://")
        self.seconds, self.unit = float(options.get("recordseconds", 1.0)), options.get("unit", "uV")
        self.start = options.get("start", "2000-01-01 00:00:00")
        self.temporary = os.path.join(self.folder, f"_temporary-{uuid.uuid4().hex}")

    def header(self, labels: list[str], samples: list[int], limit: float, records: int) -> bytes:
        begun = datetime.datetime.fromisoformat(self.start)
        ns = len(labels)
        main = f"{'0':<8}{'':<80}{'':<80}{begun:%d.%m.%y%H.%M.%S}{256 * (ns + 1):<8}{'':<44}{records:<8}{self.seconds:<8g}{ns:<4}"
        number = lambda v: f"{v:.8g}"[:8].ljust(8)
        columns = [[f"{c[:16]:<16}" for c in labels], [" " * 80] * ns, [f"{self.unit[:8]:<8}"] * ns, [number(-limit)] * ns, [number(limit)] * ns, [f"{-32767:<8}"] * ns, [f"{32767:<8}"] * ns, [" " * 80] * ns, [f"{n:<8}" for n in samples], [" " * 32] * ns]
        return (main + "".join(map("".join, columns))).encode("latin-1")

    def write(self, iterator) -> _Written:
        import numpy as np

        folder = os.path.join(self.temporary, uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        moves, name, f = [], None, None

        def close() -> None:
            if f:
                f.seek(236)
                f.write(f"{done:<8}".encode("latin-1"))
                f.close()

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["file_name"] != name:
                        close()
                        name, labels, done = row["file_name"], row["labels"], 0
                        sizes, limit = [len(s) for s in row["signals"]], float(f"{row['limit'] or 1.0:.8g}"[:8])
                        f = open(os.path.join(folder, name), "wb")  # noqa: SIM115  closed with the recording
                        moves.append((os.path.join(folder, name), os.path.join(self.folder, name)))
                        f.write(self.header(labels, sizes, limit, -1))
                    if row["labels"] != labels or row["record"] != done or any(len(s) > n for s, n in zip(row["signals"], sizes, strict=True)):
                        raise ValueError(f"record {row['record']} of {name} does not follow record {done - 1}")
                    for s, n in zip(row["signals"], sizes, strict=True):  # the last record may be short
                        x = np.concatenate([np.array(s, float), np.zeros(n - len(s))])
                        f.write(np.rint(np.clip(x / limit, -1, 1) * 32767).astype("<i2").tobytes())
                    done += 1
            close()
        except BaseException:
            if f:
                f.close()
            raise
        return _Written(moves)

    def commit(self, messages: list) -> None:
        for a, b in (m for w in messages if w for m in w.moves):
            os.replace(a, b)
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


RECORDS = "file_name string, record long, limit double, labels array<string>, signals array<array<double>>"


def records(blocks: DataFrame, file_name: str, channel: str) -> DataFrame:
    """Rows for the sink from blocks (file_name, channel, block, start, signal) whose block is one record.

    All channels of a file have the same blocks. limit is the largest absolute value of the file, to which its 16 bits are spread.
    A file's records come in order, in one task.
    """
    named = blocks.select(F.col(file_name).alias("file_name"), F.col("block").cast("long").alias("record"), F.struct(F.col(channel).alias("label"), F.col("signal")).alias("channel"))
    whole = named.groupBy("file_name", "record").agg(F.sort_array(F.collect_list("channel")).alias("channels"))  # the channels of one record
    top = F.array_max(F.transform("channels", lambda c: F.array_max(F.transform(c["signal"], F.abs))))
    limits = whole.groupBy("file_name").agg(F.max(top).alias("limit"))
    made = whole.join(limits, "file_name").select("file_name", "record", "limit", F.col("channels.label").alias("labels"), F.col("channels.signal").alias("signals"))
    return made.repartition("file_name").sortWithinPartitions("file_name", "record")


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("what", "recordings")]

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))
