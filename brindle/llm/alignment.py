"""Alignment of two tokenizers' tokens on one text by galloping intersection.

1. Both tokenizers encode the whole text, a byte-level BPE (A) with a leading space and a piece model (B) that adds it; tokens
   become bytes and their ends byte offsets. A text whose joined bytes are not those of space and text, on either side, has no
   tokens here. A space after a character that is no white space always begins a token on both sides (A's pattern takes spaces
   in front only, and no piece of B has a space after another character, which is looked up in its vocabulary), so what lies
   between such places is encoded once and remembered.
2. The shorter list of ends drives a search into the longer one: from the place in proportion, steps of 1, 2, 4 ... bracket an
   end, and a binary search finds its rank. Ends in both lists slice the tokens into groups. The ranks of a token's own two
   ends give the range of the longer list's tokens that overlap it, so the links, which are as many as the tokens of both
   lists less the groups, come without comparing tokens. All texts of a block are searched at once.
3. Link counts: each document names its distinct pairs of ids once; the pairs are counted over the corpus in partial sums, and
   the highest count of each A id follows (as many rows as the vocabulary at most). Documents get their sums by joining the
   counts: the most frequent pairs, HOT at most, are broadcast, and the rows of all others are shuffled by pair, so the
   frequent pairs that every document has are never sent anywhere.

Edge cases: a null or empty text has no tokens: zeros and empty groups; rows are told apart by their place, so repeated rows
and repeated or null ids each count as a document; a very long text is encoded whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, cut, kept_table

#: Pairs whose counts are broadcast at most; characters of the texts that are aligned together, and of remembered segments.
HOT, TOGETHER, REMEMBERED = 1 << 17, 1 << 19, 1 << 22
_SPACE_AFTER_BLANK = re.compile(r"\s ")
_SEGMENT_START = re.compile(r"(?<=\S)(?= )")
_NAMES = ("id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _byte_level(path: str):
    """An encoder of many texts by a byte-level BPE, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    letters, table = byte_letters(), [b""] * made.get_vocab_size()
    for entry, k in made.get_vocab().items():
        table[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return lambda texts: [e.ids for e in made.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], table


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The same by a piece model."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [made.id_to_piece(k) for k in range(made.get_piece_size())]
    table = [bytes([int(n[3:5], 16)]) if made.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
    return lambda texts: made.encode(texts, num_threads=1), table


def gallop(short: np.ndarray, long: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of short, the first place of the ascending long in low..high whose value is not smaller; the last has none that is.

    From near, steps that double bracket the place; then the bracket is halved. All searches advance together.
    """
    smaller = long[near] < short
    left, right = np.where(smaller, near, low - 1), np.where(smaller, high, near)  # long[left] < short <= long[right]
    step, waiting = 1, np.arange(len(short))
    while len(waiting):
        up = smaller[waiting]
        at = np.where(up, np.minimum(near[waiting] + step, high[waiting]), np.maximum(near[waiting] - step, low[waiting]))
        less = long[at] < short[waiting]
        left[waiting[less]], right[waiting[~less]] = at[less], at[~less]
        waiting = waiting[(up == less) & (at > low[waiting]) & (at < high[waiting])]
        step *= 2
    while (open_ := np.flatnonzero(right - left > 1)).size:
        middle = (left[open_] + right[open_]) >> 1
        less = long[middle] < short[open_]
        left[open_[less]], right[open_[~less]] = middle[less], middle[~less]
    return right


class Segments:
    """Ids of both tokenizers for texts, by remembered segments; what is remembered is forgotten at REMEMBERED characters."""

    def __init__(self, encode_a: Callable, a_table: list[bytes], encode_b: Callable, b_table: list[bytes]) -> None:
        self.encode, self.tables = (encode_a, encode_b), (a_table, b_table)
        self.sizes = [np.array(list(map(len, t)), np.int64) for t in self.tables]
        self.names = list(map(str, range(max(map(len, self.tables)))))
        #: Whether a piece of B holds a space after another character: then texts are not cut.
        self.whole = any(b" " in p.lstrip(b" ") for p in b_table)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.right = np.empty(0, bool)
        self.ids = [np.empty(0, np.int64) for _ in "ab"]
        self.starts = [np.zeros(1, np.int64) for _ in "ab"]

    def cut(self, text: str) -> list[str]:
        """The segments of space and text, each without its first space."""
        if self.whole:
            return [text]
        if _SPACE_AFTER_BLANK.search(text) or text[:1] == " ":
            return [p[1:] for p in _SEGMENT_START.split(" " + text)]
        return text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces, from those of the text that they make after a letter, with single spaces between; one by one where bytes differ."""
        if not pieces:
            return
        text = "x " + " ".join(pieces)
        want = (" " + text).encode()
        found = [np.array(encode([text])[0], np.int64) for encode in self.encode]
        same = all(b"".join(map(table.__getitem__, ids.tolist())) == want for table, ids in zip(self.tables, found, strict=True))
        if not same and len(pieces) > 1:
            for p in pieces:
                self.learn([p])
            return
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.size += len(text)
        self.right = np.append(self.right, np.full(len(pieces), same))
        stops = 2 + np.cumsum([0] + [1 + len(p.encode()) for p in pieces])
        for k, (ids, sizes) in enumerate(zip(found, self.sizes, strict=True)):
            ends = np.searchsorted(np.cumsum(sizes[ids]), stops) + 1 if same else np.zeros(2, np.int64)
            self.starts[k] = np.concatenate([self.starts[k], len(self.ids[k]) + ends[1:] - ends[0]])
            self.ids[k] = np.concatenate([self.ids[k], ids[ends[0] : ends[-1]]])

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether each text's bytes are right on both sides; and for A and B the ids of these texts in a row, with how many each has."""
        if self.size > REMEMBERED:
            self.forget()
        cut = [self.cut(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in self.known]
        if new:
            apart = [not p[-1:].strip() or "▁" in p for p in new]  # what follows them need not begin a token, or their bytes differ
            self.learn([p for p, own in zip(new, apart, strict=True) if not own])
            for p, own in zip(new, apart, strict=True):
                if own:
                    self.learn([p])
        count = np.array(list(map(len, cut)))
        segment = np.fromiter(map(self.known.__getitem__, (p for c in cut for p in c)), np.int64, count.sum())
        text = np.repeat(np.arange(len(texts)), count)
        right = (count > 0) & (np.bincount(text, ~self.right[segment], len(texts)) == 0)
        kept = right[text]
        segment, text = segment[kept], text[kept]
        sides = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            n = (starts[1:] - starts[:-1])[segment]
            place = np.arange(n.sum()) + np.repeat(starts[segment] - (np.cumsum(n) - n), n)
            sides.append((ids[place], np.bincount(text, n, len(texts))[right].astype(np.int64)))
        return right, sides


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the ends of groups as counts of A and of B tokens, and the links as places of A and of B tokens.

    a and b hold the ids of all texts in a row, n_a and n_b how many each has; their sizes in bytes have one sum on both sides.
    """
    swapped = (n_a > n_b).tolist()
    ends = [np.split(np.cumsum(size[ids]), np.cumsum(n)[:-1]) for size, ids, n in ((a_size, a, n_a), (b_size, b, n_b))]  # of one text after the other
    short = [y if s else x for x, y, s in zip(*ends, swapped, strict=True)]
    long = [x if s else y for x, y, s in zip(*ends, swapped, strict=True)]
    shorts, longs = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    text = np.repeat(np.arange(len(short)), shorts)
    first_short, first_long = np.cumsum(shorts) - shorts, np.cumsum(longs) - longs
    own = np.arange(len(text)) - first_short[text]
    low, high = first_long[text], (first_long + longs - 1)[text]
    near, far = np.concatenate(short), np.concatenate(long)
    rank = gallop(near, far, low + own * longs[text] // shorts[text], low, high)
    hit = far[rank] == near
    begin = np.concatenate([[0], rank[:-1] + hit[:-1]])  # the first token of the long list that overlaps each of the short one
    width = rank - begin + 1
    link_short = np.repeat(own, width)
    link_long = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin - low, width)
    stops, links = np.cumsum(shorts), np.concatenate([[0], np.cumsum(width)])
    for k in range(len(short)):
        s = slice(first_short[k], stops[k])
        here = np.flatnonzero(hit[s])
        groups = (here + 1, rank[s][here] - first_long[k] + 1)
        found = slice(links[first_short[k]], links[stops[k]])
        pair = (link_short[found], link_long[found])
        yield (*(groups[::-1] if swapped[k] else groups), *(pair[::-1] if swapped[k] else pair))


def group_text(a: list[int], b: list[int], a_ends: np.ndarray, b_ends: np.ndarray, names: list[str]) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``; names has the digits of each id."""
    out, i, j = [], 0, 0
    x, y = list(map(names.__getitem__, a)), list(map(names.__getitem__, b))
    for k, m in zip(a_ends.tolist(), b_ends.tolist(), strict=True):
        out.append(f"{x[i]}|{y[j]}" if k - i == 1 and m - j == 1 else f"{','.join(x[i:k])}|{','.join(y[j:m])}")
        i, j = k, m
    return ";".join(out)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), id, n_a, n_b, n_groups, n_links, groups (text), and the distinct linked pairs with their times.

    A pair is A id * 2**32 + B id.
    """
    bounded_batches(docs.sparkSession, 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def block(texts: list[str], segments: Segments) -> list[tuple]:
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        right, ((a, n_a), (b, n_b)) = segments.encoded(texts)
        if right.any():
            ids_a, ids_b = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((a, n_a), (b, n_b)))
            for k, x, y, (ga, gb, la, lb) in zip(np.flatnonzero(right).tolist(), ids_a, ids_b, align(a, b, n_a, n_b, *segments.sizes), strict=True):
                pairs, times = np.unique((x[la] << 32) + y[lb], return_counts=True)
                out[k] = (len(x), len(y), len(ga), len(la), group_text(x.tolist(), y.tolist(), ga, gb, segments.names), pairs, times)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(*_byte_level(a_path), *_pieces(b_path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + len(texts[stop]) <= TOGETHER):
                    total += len(texts[stop])
                    stop += 1
                n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*block(texts[at:stop], segments), strict=True)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.asarray(v, np.int64) for v in x]), pa.int64()).cast(t))
                counts = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links)]
                columns = [pa.array(np.arange(row, row + stop - at)), batch.column(0).slice(at, stop - at), *counts, pa.array(groups, pa.string()), lists(pairs, pa.int64()), lists(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *_NAMES])
                row += stop - at
                at = stop

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = narrow.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")
    return made.withColumnRenamed("id", id_col) if id_col != "id" else made


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its A id), kept in the shared folder."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has entries at most
    return cut(counts.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _hot_level(counts: DataFrame, most: int) -> int:
    """The least count of which, and of higher ones, there are ``most`` pairs or fewer; from counts by powers of 2**(1/8)."""
    level = F.floor(F.log2("n") * 8)
    found = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # 500 rows at most
    total, least = 0, 1 << 62
    for r in found:
        total += r["pairs"]
        if total > most:
            break
        least = r["least"]
    return least


def link_sums(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """row, n_best (links whose count is the highest of their A id) and count_sum (over links) of the rows that have links."""
    least = _hot_level(counts, hot)
    few, many = F.broadcast(counts.filter(F.col("n") >= least)), counts.filter(F.col("n") < least)
    single = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    cold = single.join(few.select("pair"), "pair", "left_anti").join(many, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [side.groupBy("row").agg(*sums) for side in (single.join(few, "pair"), cold)]
    return parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (empty without tokens) of every row."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = kept_table(align_documents(docs, a_path, b_path, id_col, text_col).withColumn("groups_sha256", digest).drop("groups"))
    sums = link_sums(rows, pair_counts(rows))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
