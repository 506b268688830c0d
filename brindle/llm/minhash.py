"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes the sequence of its words (A-Z in lower case) and the set of its distinct 5-word shingles; texts with the
   same sequence, told by a digest of its bytes, form one class, so exact copies cost nothing further.
2. A class has 256 minima of hashed shingles. Bands of four of the first 128 give 32 keys; the low four bits of all minima are
   packed into 16 longs.
3. Classes that share a key are candidates. In a bucket each class is held against one head, never against all others.
   Candidates whose bit counts put the collision-corrected similarity under a floor five standard deviations below the
   threshold are dropped; of the others each class has its likeliest few confirmed on their full sets. Confirmed links join
   classes into components, and rounds with other heads follow in the buckets that still hold several components.
4. What several components still share after these rounds is looked at whole, so that no link that could join two components
   is left out. Classes of large buckets form groups (buckets that share a class belong together), cut into blocks; a task
   gets the texts of one pair of blocks, confirms the pairs from different components with like bits, and returns a spanning
   forest of the links. In small buckets such pairs are joined and confirmed. Pairs of a large group are never emitted.
5. Components are named over classes, and rows take theirs by class; classes and components that hold over a thousandth of the
   rows are fewer than a thousand and are broadcast, so no task gets all rows of one.

At the threshold of 0.75, two sets share none of the 32 keys with probability 5e-6.

Edge cases: a null, empty or blank text has no shingle and links with nothing; a text of one to four words has its whole
sequence as its one shingle; rows may repeat, and rows of equal texts share a component whatever their ids; a null id takes
part and never becomes the smallest unless it is alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import WORD, bounded_batches, cut, kept_table, looked_up
from brindle.llm.graph import connected

WIDTH, HASHES, BANDS, ROWS, BITS = 5, 256, 32, 4, 4
#: Candidates are confirmed if their estimated similarity is threshold - MARGIN or more: five standard deviations of the estimate.
MARGIN = 0.14
#: Rounds of one head a bucket, and how many of a class's candidates a round confirms; the last look is over all that is left.
HEAD_ROUNDS, LIKELIEST = 3, 3
#: A bucket of more classes is large; classes of a group in one block.
LARGE, BLOCK = 48, 384
#: Words whose digest a worker remembers.
MEMO = 1 << 19

_rng = np.random.default_rng(20240229)
_SLOPES = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_powers: list[np.ndarray] = []
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for rolling hashes of bytes."""
    if not _powers or len(_powers[0]) < size:
        n = max(size, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


class _Hashes(dict):
    """64-bit digests of words; short ones are remembered, as many as MEMO at once."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case; bytes.split knows the six blanks of WORD alone."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[tuple[bytes, np.ndarray]]:
    """A 16-byte digest of the word sequence and the distinct hashed shingles of each text; no words: an empty key and set."""
    out = []
    for text in texts:
        words = words_of(text)
        n = len(words)
        if not n:
            out.append((b"", np.empty(0, np.uint64)))
            continue
        own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
        if n < width:
            found = _mix((own * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACES[8 + n])
        else:
            runs = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                runs += own[j : n - width + 1 + j] * _PLACES[j]
            found = np.unique(_mix(runs))
        out.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), found))
    return out


def minima(found: np.ndarray) -> np.ndarray:
    """The minima of a set of hashed shingles."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        h = x[None, at : at + 1024] * _SLOPES[:, None] + _SHIFTS[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band of each row of minima."""
    rows = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    for j in range(ROWS):
        key = _mix(key ^ (rows[:, :, j] * _PLACES[j]))
    return key.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, 16 to a long."""
    four = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, 64 // BITS)
    return np.bitwise_or.reduce(four << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, n_shingles, bands and bits of every row; bands and bits are null where there is no shingle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            low = np.array([minima(s) for _, s in sets], np.uint32).reshape(len(sets), HASHES)
            none = np.array([len(s) == 0 for _, s in sets])
            lists = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)), mask=pa.array(none)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k for k, _ in sets], pa.binary()), pa.array([len(s) for _, s in sets], pa.int64()), lists(band_keys(low)), lists(packed_bits(low))],
                names=[id_col, "key", "n_shingles", "bands", "bits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key binary, n_shingles long, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the packed bits of two signatures, corrected for chance agreement of four bits."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1.0 / (1 << BITS)
    return ((F.lit(float(HASHES)) - differ) / HASHES - chance) / (1 - chance)


_words = re.compile(WORD).findall
_lower = str.maketrans({c: c + 32 for c in range(65, 91)})


def full_set(text: str) -> set:
    """The distinct shingles themselves, as tuples of words."""
    words = _words(text.translate(_lower))
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(WIDTH)), strict=False))


def class_texts(keys: DataFrame, docs: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and text of the classes in keys (key). names has a class's key and one id.

    Texts are fetched by id and told apart by key, so ids need not be unique. Kept in the shared folder, for all rounds.
    """
    wanted = keys.distinct().join(names, "key")
    fetched = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text")).join(wanted, F.col("id__").eqNullSafe(F.col("id")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            mask = pa.array([k == s[0] for k, s in zip(keys, shingle_sets(texts), strict=True)], pa.bool_())
            yield batch.filter(mask)

    return kept_table(fetched.select("key", "text").mapInArrow(own, "key binary, text string").dropDuplicates(["key"]))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets have 100 * intersection >= percent * union."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = full_set(x), full_set(y)
                common = len(s & t)
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(alike, "a binary, b binary"))


def _alike(a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Which rows of packed bits a are like which of b, by the estimate."""
    out = np.empty((len(a), len(b)), bool)
    ones = np.uint64(0x1111111111111111)
    for at in range(0, len(a), 64):
        x = a[at : at + 64, None, :] ^ b[None, :, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        same = HASHES - np.bitwise_count(x & ones).sum(axis=2, dtype=np.int64)
        chance = 1 / (1 << BITS)
        out[at : at + 64] = (same / HASHES - chance) / (1 - chance) >= floor
    return out


def _cell_links(rows: list[tuple], percent: int, floor: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between classes (second block, key, part, bits, text) of different components."""
    one = [r for r in rows if not r[0]]
    two = [r for r in rows if r[0]] or one
    sets = {r[1]: set(s.tolist()) for r, (_, s) in zip(rows, shingle_sets([r[4] for r in rows]), strict=True)}
    near = _alike(*(np.array([r[3] for r in b], np.int64).view(np.uint64).reshape(len(b), -1) for b in (one, two)), floor)
    parent: dict[bytes, bytes] = {}

    def root(k: bytes) -> bytes:
        while (up := parent.get(k, k)) != k:
            parent[k] = parent.get(up, up)
            k = parent[k]
        return k

    links = []
    for i, j in np.argwhere(near).tolist():
        a, b = one[i], two[j]
        if a[2] == b[2] or (two is one and j <= i):
            continue
        x, y = root(a[2]), root(b[2])  # components that this cell has joined already need no further link
        if x == y:
            continue
        s, t = sets[a[1]], sets[b[1]]
        common = len(s & t)
        if 100 * common < percent * (len(s) + len(t) - common):
            continue
        s, t = full_set(a[4]), full_set(b[4])  # the hashes agree, now the words
        common = len(s & t)
        if 100 * common >= percent * (len(s) + len(t) - common):
            parent[y] = x
            links.append((max(a[1], b[1]), min(a[1], b[1])))
    return links


def group_links(large: DataFrame, bits: DataFrame, texts: DataFrame, percent: int, floor: float) -> DataFrame:
    """Links (a, b) between components within the groups of large buckets (band, key, part)."""
    least = large.groupBy("band").agg(F.min("key").alias("head"))
    groups = connected(large.join(least, "band").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()).toDF("key", "group")
    sizes = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "group").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["group", "low", "high"]
    dealt = dealt.select("group", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("second"), "key")
    full = dealt.join(large.select("key", "part").distinct(), "key").join(bits, "key").join(texts, "key").select(*cell, "second", "key", "part", "bits", "text")
    spread = max(1, int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = full.repartition(spread, *cell).sortWithinPartitions(*cell, "second", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            links = _cell_links([r[3:] for r in rows], percent, floor)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from done(held)
                    held = []
                held.append(row)
        if held:
            yield from done(held)

    return cut(full.mapInArrow(run, "a binary, b binary"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, itself included) and kept (id = component_id)."""
    floor = percent / 100 - MARGIN
    like = estimate(F.col("bits_x"), F.col("bits_y"))
    rows = cut(signatures(docs, id_col, text_col))
    classes = cut(
        rows.filter("n_shingles > 0").groupBy("key").agg(F.min(id_col).alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    )
    keyed = classes.select(F.explode("bands").alias("band"), "key")
    shared = keyed.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least != most").select("band")
    members = cut(keyed.join(shared, "band"))
    bits = cut(classes.select("key", "bits").join(members.select("key").distinct(), "key"))
    texts = class_texts(members.select("key"), docs, classes.select("key", "id"), id_col, text_col)
    parts = None

    def placed() -> DataFrame:
        """Members of the buckets that hold several components, with theirs."""
        if parts is None:
            return members.withColumn("part", F.col("key"))
        own = members.join(parts.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("part"))
        several = own.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most").select("band")
        return cut(own.join(several, "band"))

    def joined(links: DataFrame) -> DataFrame:
        known = links if parts is None else links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return connected(known)

    for k in range(HEAD_ROUNDS):
        now = placed()
        heads = now.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(k), "key").alias("order"), "key", "part")).alias("head"))
        held = now.join(heads, "band").filter(F.col("part") != F.col("head.part")).select(F.col("key").alias("a"), F.col("head.key").alias("b")).distinct()
        near = held.join(bits.toDF("a", "bits_x"), "a").join(bits.toDF("b", "bits_y"), "b").select("a", "b", like.alias("like")).filter(F.col("like") >= floor)
        best = Window.partitionBy("a").orderBy(F.col("like").desc(), "b")
        links = confirm(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LIKELIEST), texts, percent)
        if links.isEmpty():
            break
        parts = joined(links)
    now = placed()
    crowded = now.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("band")
    large = cut(now.join(crowded, "band"))
    if not large.isEmpty():
        links = group_links(large, bits, texts, percent, floor)
        if not links.isEmpty():
            parts = joined(links)
            now = placed()
    inside = cut(now.join(large.select("band").distinct(), "band", "left_anti").join(bits, "key"))
    x, y = inside.toDF(*[f"{c}_x" for c in inside.columns]), inside.toDF(*[f"{c}_y" for c in inside.columns])
    across = (F.col("band_x") == F.col("band_y")) & (F.col("part_x") < F.col("part_y")) & (like >= floor)
    rest = confirm(x.join(y, across).select(F.col("key_x").alias("a"), F.col("key_y").alias("b")).distinct(), texts, percent)
    if parts is None or not rest.isEmpty():
        parts = joined(rest)

    named = classes.select("key", "n").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.select("key", "id").join(named, "key").groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    lines = cut(looked_up(named, cut(least), "component", "classes").select("key", "component_id", "n"))
    own = rows.select(F.col(id_col).alias("id"), "key", "n_shingles")
    none = own.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    done = looked_up(own.filter("n_shingles > 0"), lines, "key").select("id", "n_shingles", "component_id").unionByName(none)
    return done.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of groups but one: that of the smallest id. Rows with equal ids and texts stay once.

    Rows are told apart by id, so all different texts without an id stay if one of them does."""
    name = "kept_id" + "_" * max(map(len, docs.columns))  # no column of docs has it
    kept = cut(near_duplicates(docs, percent, id_col, text_col).filter("kept").select(F.col(id_col).alias(name)))
    rows, ids = kept.agg(F.count(F.lit(1)), F.count_distinct(F.struct(name))).first()
    left = docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    return left if rows == ids else left.dropDuplicates([id_col, text_col])
