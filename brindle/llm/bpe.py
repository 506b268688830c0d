"""Byte-level BPE encoding by merge replay, and decoding.

A task splits its documents into pre-tokens and keeps the distinct ones it has not met. Over this block of the corpus it
builds an inverted index: for every token that a pair of neighbours can form, the positions of such pairs. Merges are then
replayed in rank order; each one takes its positions from the index and updates only the touched neighbours, so that a
pre-token is merged once however often it occurs. Pre-tokens never share a merge, so a block gives the ids that the whole
corpus in one index would. A merge can form a pair of lower rank than its own; that pair goes first, as it would in a
single word.

Edge cases: a null or empty text has no ids and decodes to no bytes; texts of any length are one row of work whose memory is
proportional to its own length; equal texts get equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches

#: Distinct pre-tokens that a task remembers between blocks; it starts anew beyond that, which bounds its memory.
REMEMBERED = 500_000
#: Pairs of tokens whose rank a task remembers.
PAIRS = 500_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def load_tokens(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


@lru_cache(maxsize=2)
def byte_pair_ranks(path: str) -> np.ndarray:
    """Rank of the token that each two bytes form, at first * 256 + second; -1 for none."""
    ranks = load_ranks(path)
    return _byte_pairs(ranks)


def _byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    out = np.full(1 << 16, -1, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            out[token[0] << 8 | token[1]] = rank
    return out


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: list[bytes], byte_pairs: np.ndarray | None = None, formed: dict[int, int] | None = None) -> list[list[int]]:
    """Ids of each word, by replaying the merges over all of them at once. formed remembers the ranks of pairs between calls."""
    byte_pairs = _byte_pairs(ranks) if byte_pairs is None else byte_pairs
    formed = {} if formed is None else formed
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    size = len(flat)
    sizes = np.array([len(w) for w in words], np.int64)
    stops = np.cumsum(sizes)
    last = stops[sizes > 0] - 1
    tok = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)[flat].tolist()
    left, right = np.arange(-1, size - 1), np.arange(1, size + 1)
    left[stops[sizes > 0] - sizes[sizes > 0]] = -1
    right[last] = -1
    pairs = np.full(size, -1, np.int64)
    if size:
        pairs[:-1] = byte_pairs[flat[:-1] << 8 | flat[1:]]
        pairs[last] = -1
    index: dict[int, list[int]] = {}  # rank of the token that a pair forms: positions of such pairs
    places = np.argsort(pairs, kind="stable")[int((pairs < 0).sum()) :]
    edges = np.flatnonzero(np.diff(pairs[places], prepend=-1))
    for own in np.split(places, edges[1:]) if len(places) else []:
        index[int(pairs[own[0]])] = own.tolist()
    forms, left, right = pairs.tolist(), left.tolist(), right.tolist()
    order = list(index)
    heapify(order)
    known, find = formed.get, ranks.get
    while order:
        r = heappop(order)
        places = index.pop(r, None)
        if not places:
            continue
        places.sort()
        mine, shifted = tokens[r], r << 17
        for k, p in enumerate(places):
            if forms[p] != r:
                continue
            q = right[p]
            after, before, lower = right[q], left[p], False
            tok[p], right[p], forms[q] = r, after, -1
            if after >= 0:
                left[after] = p
                pair = shifted | tok[after]
                new = known(pair)
                if new is None:
                    new = formed[pair] = find(mine + tokens[tok[after]], -1)
                forms[p] = new
                if new >= 0:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heappush(order, new)
                    lower = new < r
            else:
                forms[p] = -1
            if before >= 0:
                pair = tok[before] << 17 | r
                new = known(pair)
                if new is None:
                    new = formed[pair] = find(tokens[tok[before]] + mine, -1)
                forms[before] = new
                if new >= 0:
                    if new in index:
                        index[new].append(before)
                    else:
                        index[new] = [before]
                        heappush(order, new)
                    lower = lower or new < r
            if lower:  # the rest waits until the lower rank is done
                if r in index:
                    index[r].extend(places[k + 1 :])
                else:
                    index[r] = places[k + 1 :]
                    heappush(order, r)
                break
    out = []
    for s, n in zip((stops - sizes).tolist(), sizes.tolist(), strict=True):
        ids, p = [], s if n else -1
        while p >= 0:
            ids.append(tok[p])
            p = right[p]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts of a task; remembers pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks, self.tokens = load_ranks(path), load_tokens(path)
        self.split = regex.compile(pattern).findall
        self.byte_pairs, self.formed = byte_pair_ranks(path), {}
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        if len(self.formed) > PAIRS:
            self.formed = {}
        pending, ranks = [], self.ranks
        for w in words - self.known.keys():
            b = w.encode()
            if b in ranks:  # a pre-token that is a token stays whole
                self.known[w] = np.array([ranks[b]], "<u4").tobytes()
            else:
                pending.append((w, b))
        found = replay([b for _, b in pending], ranks, self.tokens, self.byte_pairs, self.formed)
        sizes = [len(ids) for ids in found]
        flat, at = np.array([i for ids in found for i in ids], "<u4").tobytes(), 0
        for (w, _), n in zip(pending, sizes, strict=True):
            self.known[w] = flat[at : at + 4 * n]
            at += 4 * n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces = [self.split(t) if t else [] for t in texts]
        self.learn({w for p in pieces for w in p})
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (binary: little-endian unsigned 32-bit) of every text, as the ranks file at path gives them."""
    bounded_batches(docs.sparkSession, 1)  # lists of all positions of new pre-tokens are many times the size of their texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """encoded with ``decoded``: the bytes that ids stand for. An id outside of the ranks file is an error."""
    bounded_batches(encoded.sparkSession, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(path)
        for batch in batches:
            decoded = [b"".join([tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
