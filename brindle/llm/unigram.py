"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with a leading "▁"; its tokens are the pieces of its likeliest segmentation. A task inserts the distinct
pre-tokens of its documents in a trie. A node stands for a prefix and is scored when it is made: the best score of the prefix
is the best, over the pieces that end it, of the score of what stands before plus the piece's own. All pre-tokens that share
a prefix share its nodes, and a pre-token's last node stores its token count.

The pieces are those of a public vocabulary; their probabilities follow the Zipf-Mandelbrot law of their ranks. A character
that no piece spells is one token for each of its UTF-8 bytes. Among equally likely segmentations the fewest tokens count.

Edge cases: a null, empty or blank text has no word and no token; rows may repeat; a word of any length costs time in
proportion to it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import WORD, bounded_batches

START = "▁"
#: Nodes and words that a task remembers; beyond that it starts with an empty trie, which bounds its memory.
NODES, WORDS = 1_500_000, 400_000
MANDELBROT = 2.7

_words = re.compile(WORD).findall


@lru_cache(maxsize=2)
def load_pieces(path: str) -> dict[str, float]:
    """Log probability of each piece of a SentencePiece model, by rank; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + MANDELBROT) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + MANDELBROT) - total for r, i in enumerate(plain)}


class Trie:
    """Distinct pre-tokens by shared prefix; best score and fewest tokens of each prefix."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.ends = {p[k:] for p in pieces for k in range(len(p))}  # what a piece may end with
        self.worst = min(pieces.values(), default=0.0) - 10.0
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, token: str) -> int:
        """The last node of token, after scoring the prefixes that are new."""
        children, score, count, pieces, ends = self.children, self.score, self.count, self.pieces, self.ends
        node, path = 0, [0]
        for i, c in enumerate(token):
            after = children.get((node, c))
            if after is None:
                size = len(c.encode())
                best, fewest = score[node] + self.worst * size, count[node] + size
                j = i
                while j >= 0 and (piece := token[j : i + 1]) in ends:
                    own = pieces.get(piece)
                    if own is not None:
                        s, n = score[path[j]] + own, count[path[j]] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                    j -= 1
                after = children[node, c] = len(score)
                score.append(best)
                count.append(fewest)
            node = after
            path.append(node)
        return node


class Counter:
    """Counts the words and tokens of texts in a task."""

    def __init__(self, path: str) -> None:
        self.pieces = load_pieces(path)
        self.forget()

    def forget(self) -> None:
        self.trie, self.known = Trie(self.pieces), {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        words = [_words(t) if t else [] for t in texts]
        fresh = {w for own in words for w in own} - self.known.keys()
        if len(self.trie.score) > NODES or len(self.known) + len(fresh) > WORDS:
            self.forget()
            fresh = {w for own in words for w in own}
        insert, counts = self.trie.insert, self.trie.count
        for w in fresh:
            self.known[w] = counts[insert(START + w)]
        get = self.known.__getitem__
        return [len(own) for own in words], [sum(map(get, own)) for own in words]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every text, with the pieces of the SentencePiece model at path."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            words, tokens = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
