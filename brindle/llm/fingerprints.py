"""Document fingerprints from statistically improbable byte windows.

Each window of 64 bytes gets the entropy of its bytes and from it a rarity rank: the less dense a reference distribution of
entropies (that of prose, ``USUAL`` and ``SPREAD``) is at its value, the rarer. Among every 64 neighbouring windows the rarest
(leftmost among equals) scores a point; windows with 16 points or more are the text's features. Hashed features go into a
chain of Bloom filters of 2,048 bits, five bits a feature, 160 features a filter. Two digests are compared filter by filter:
common bits beyond what chance gives, as a share of what the smaller filter could have in common; each filter of the shorter
chain takes its best partner, and filters count by their features.

Neighbours in id order meet without a window over all rows: ids are cut at quantiles into as many ranges as there are shuffle
partitions, each range is sorted in its task, and the first row of the next range comes along as a marker.

Texts under 384 bytes have few such windows, so all their windows of 16 bytes are features too. In longer texts windows may
tie or be too plain to win, as in a repeated unit, whatever its length. Wherever 160 windows or more in a row have no feature, the windows
of 16 bytes in them are winnowed: of every 48 neighbours the one of the smallest hash is a feature. So only empty texts have none.

Edge cases: a null text is an empty one; texts under 16 bytes are one padded window, an empty text has no feature; equal fingerprints have likeness 1, an empty one and another 0; rows of one id
follow each other by the hash of their text; a null id comes last; a single row is its own neighbour; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches
from brindle.llm.minhash import _mix, _power_tables

WINDOW, SMALL, SHORT, POINTS, FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 64, 16, 384, 16, 2048, 160, 5
QUIET, WINNOW = 160, 48  # windows in a row without a feature; neighbours of which the smallest hash is one then
#: Mean and standard deviation of the reference entropies, in thousandths of the maximum; under LEAST a window is no feature.
USUAL, SPREAD, LEAST = 620.0, 40.0, 120
CORE = 1 << 16  # windows of a long text that are looked at together
_NEVER = np.int64(1) << np.int64(62)

_gain = np.array([round(65536 * ((n + 1) * np.log2(n + 1) - (n * np.log2(n) if n else 0))) for n in range(WINDOW)], np.int64)
_whole = np.concatenate([[0], np.cumsum(_gain)])
_rank = np.array([round(1e9 * np.exp(-0.5 * ((e - USUAL) / SPREAD) ** 2)) if e >= LEAST else -1 for e in range(1001)], np.int64)


def window_entropies(x: np.ndarray) -> np.ndarray:
    """Entropy of each window of 64 bytes, in thousandths of the maximum. Counts of equal bytes are updated from window to window."""
    n = len(x)
    if n < WINDOW:
        return np.empty(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (x[k:] == x[:-k]).view(np.uint8)
        before[k:] += same
        after[: n - k] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _whole[np.bincount(x[:WINDOW], minlength=256)].sum()
    total[1:] = _gain[before[WINDOW:]] - _gain[after[: n - WINDOW]]
    np.cumsum(total, out=total)
    return 1000 - (total * 1000) // _whole[WINDOW]


def _features(pieces: list[tuple[bytes, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each piece (bytes, first window, last window), those with enough points, then a short text's small windows; and the places of the former."""
    sizes = np.array([len(p[0]) for p in pieces])
    x = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    rank = _rank[window_entropies(x)]
    n = len(rank)
    place = np.arange(n, dtype=np.int64)
    key = np.where((piece[:n] == piece[WINDOW - 1 :]) & (rank >= 0), (rank << np.int64(31)) | place, _NEVER)
    least = key
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    whole = piece[: len(least)] == piece[2 * WINDOW - 2 : 2 * WINDOW - 2 + len(least)] if len(least) else np.empty(0, bool)
    whole = np.concatenate([whole, np.zeros(len(least) - len(whole), bool)])
    winners = least[whole & (least < _NEVER)] & np.int64((1 << 31) - 1)
    points = np.bincount(winners, minlength=n)
    up, down = _power_tables(len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])])
    out = []
    for k, (data, first, last) in enumerate(pieces):
        a = begin[k]
        at = np.flatnonzero(points[a + first : a + max(first, min(last, len(data) - WINDOW + 1))] >= POINTS) + a + first
        own, places = _mix((sums[at + WINDOW] - sums[at]) * down[at]), at - a
        if first == 0 and len(data) < SHORT:
            at = np.arange(a, a + len(data) - SMALL + 1)
            own = np.concatenate([own, _mix((sums[at + SMALL] - sums[at]) * down[at] + np.uint64(SMALL))])
        out.append((own, places))
    return out


def quiet_features(text: bytes, places: np.ndarray) -> list[np.ndarray]:
    """Hashed small windows winnowed from every stretch of QUIET windows or more between the places of features."""
    ends = np.concatenate([[-1], places, [len(text) - WINDOW + 1]])
    out = []
    for k in np.flatnonzero(np.diff(ends) > QUIET):
        first, stop = int(ends[k]) + 1, int(ends[k + 1]) + WINDOW - SMALL  # small windows inside the stretch
        for at in range(first, stop - WINNOW + 1, CORE):
            x = np.frombuffer(text, np.uint8, min(stop, at + CORE + WINNOW - 1) - at + SMALL - 1, at)
            up, down = _power_tables(len(x) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])])
            n = len(x) - SMALL + 1
            least = _mix((sums[SMALL:] - sums[:n]) * down[:n] + np.uint64(SMALL))
            for step in (1, 2, 4, 8, 16, WINNOW - 32):
                least = np.minimum(least[:-step], least[step:])
            _, place = np.unique(least, return_index=True)
            out.append(least[np.sort(place)])
    return out


def text_features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashed features of each text, in order of their first place. Long texts are looked at in overlapping pieces."""
    pieces, owner, begins = [], [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        t = t.ljust(SMALL, b"\0")
        for core in range(0, max(1, len(t) - WINDOW + 1), CORE):
            start = max(0, core - WINDOW)
            pieces.append((t[start : core + CORE + 3 * WINDOW], core - start, core - start + CORE))
            owner.append(k)
            begins.append(start)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    seen: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        stop, held = at, 0
        while stop < len(pieces) and (stop == at or held + len(pieces[stop][0]) <= 2 * CORE):
            held += len(pieces[stop][0])
            stop += 1
        for k, place, (f, places) in zip(owner[at:stop], begins[at:stop], _features(pieces[at:stop]), strict=True):
            found[k].append(f)
            seen[k].append(places + place)
        at = stop
    for text, parts, places in zip(texts, found, seen, strict=True):
        if len(text) >= SHORT:
            parts += quiet_features(text, np.concatenate(places))
    out = []
    for parts in found:
        all_parts = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        _, first = np.unique(all_parts, return_index=True)
        out.append(all_parts[np.sort(first)])
    return out


def chain(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (rows of 256 bytes) of features, and how many features each holds."""
    n = -(-len(features) // FILTER_FEATURES)
    bits = np.zeros((n, FILTER_BITS), bool)
    place = np.arange(len(features)) // FILTER_FEATURES
    for j in range(FEATURE_BITS):
        bits[place, (features >> np.uint64(11 * j)).astype(np.int64) % FILTER_BITS] = True
    return np.packbits(bits, axis=1), np.bincount(place, minlength=n)


def digest(filters: np.ndarray, held: np.ndarray) -> str:
    """Number of filters, features in the last one, and all bits in base 64."""
    return f"{len(filters)}:{held[-1] if len(held) else 0}:{base64.b64encode(filters.tobytes()).decode()}"


def parse_digest(text: str) -> tuple[np.ndarray, np.ndarray]:
    n, last, bits = text.split(":", 2)
    held = np.full(int(n), FILTER_FEATURES)
    if len(held):
        held[-1] = int(last)
    return np.frombuffer(base64.b64decode(bits), np.uint8).reshape(int(n), FILTER_BITS // 8), held


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Normalised bit overlap of two chains, 0 to 1."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 1.0 if not len(b[0]) else 0.0
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all():
        return 1.0
    x, y = np.ascontiguousarray(a[0]).view(np.uint64), np.ascontiguousarray(b[0]).view(np.uint64)
    ones_x, ones_y = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = np.empty(len(x))
    rows = max(1, (1 << 20) // (len(y) * x.shape[1]))
    for at in range(0, len(x), rows):
        s = slice(at, at + rows)
        common = np.bitwise_count(x[s, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
        chance = ones_x[s, None] * ones_y[None, :] / FILTER_BITS
        most = np.minimum(ones_x[s, None], ones_y[None, :])
        best[s] = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float((best * a[1]).sum() / a[1].sum())


def fingerprints(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [chain(f) for f in text_features([(t or "").encode() for t in texts])]


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the start of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def neighbouring(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and marker, grouped by id range and sorted: in each range the rows in order, then the row that follows them.

    Ranges hold about equally many rows and go to tasks in order, one each. Rows that share one id, or have none, stay in one range.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    none = F.col("id").isNull()
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    placed = rows.select(F.when(none, len(cuts) + 1).otherwise(reached).alias("range"), none.alias("last"), "id", F.xxhash64("text").alias("h"), "text")
    firsts = placed.groupBy("range").agg(F.min(F.struct("last", "id", "h")).alias("f")).select("range", "f.last", "f.id", "f.h").collect()
    firsts.sort(key=lambda r: r["range"])  # a line for each range at most
    if not firsts:
        return rows.select("id", "text", F.lit(0).alias("range"), F.lit(False).alias("marker"))
    links = [(r["range"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame([(before, r["range"], r["id"], r["h"]) for (_, before), r in zip(links, firsts, strict=True)], "before int, own int, first_id long, first_h long")
    marked = placed.join(F.broadcast(heads), (F.col("range") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    markers = marked.dropDuplicates(["own"]).select(F.col("before").alias("range"), "last", "id", "h", "text", F.lit(True).alias("marker"))
    both = placed.withColumn("marker", F.lit(False)).unionByName(markers)
    return both.repartitionByRange(parts, "range").sortWithinPartitions("range", "marker", "last", "id", "h").select("id", "text", "range", "marker")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint, edited (the text with the next one's start in its last quarter), edited_fingerprint, near_edited and near_next.

    edited is given as the digest edited_sha256; the next text is that of the next id, after the last the first.
    """
    bounded_batches(docs.sparkSession, 2)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen: range, id, text, chain
        for batch in batches:
            ids, texts, ranges, markers = (c.to_pylist() for c in batch.columns)
            chains = fingerprints(texts)
            pairs = []
            for row in zip(ranges, ids, texts, chains, markers, strict=True):
                if held is not None and held[0] == row[0]:
                    pairs.append((held, row))
                held = None if row[4] else row
            new_texts = [edited(a[2], b[2]) for a, b in pairs]
            rows = []
            for (a, b), text, new in zip(pairs, new_texts, fingerprints(new_texts), strict=True):
                sha = hashlib.sha256(text.encode()).hexdigest()
                rows.append((a[1], len(a[2]), sha, digest(*a[3]), digest(*new), likeness(a[3], new), likeness(a[3], b[3])))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbouring(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
