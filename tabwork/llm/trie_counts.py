"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a block are put in order, which walks their trie
depth first: consecutive pre-tokens share a prefix, and the forward scores of
that prefix are computed once. The forward score of a place is the best sum of
piece scores that spell the prefix up to it; with it goes the number of pieces.
The score at a pre-token's end, its terminal, gives its token count, which is
kept for the blocks that follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from tabwork.llm import blocks as B

MARK = "▁"
MEMO = 500_000
BLOCK = 2 << 20


def piece_scores(model: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece model as log probabilities.

    The file ranks its pieces; a piece of rank r gets the Zipf probability
    1 / (r + 1), normalised. Control and byte pieces are left out.
    """
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    words = [
        pieces.id_to_piece(i) for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(words))))
    return {w: -math.log(r + 1) - total for r, w in enumerate(words)}


class Unigram:
    """Best segmentations; a character that no piece spells costs one token per UTF-8 byte."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.ends: dict = {}  # a trie of the pieces read backwards; "" holds the score
        for piece, score in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Token count of each word, walking the trie of the words depth first."""
        out, last = {}, ""
        best, tokens = [0.0], [0]
        for word in sorted(words):
            shared = len(commonprefix((last, word)))
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                top, count = best[end - 1] + self.unknown * size, tokens[end - 1] + size
                node, at = self.ends, end
                while at and (node := node.get(word[at - 1])) is not None:
                    at -= 1
                    score = node.get("")
                    if score is not None:
                        total = best[at] + score
                        if total > top or total == top and tokens[at] + 1 < count:
                            top, count = total, tokens[at] + 1
                best.append(top)
                tokens.append(count)
            out[word] = tokens[-1]
            last = word
        return out


class Counter:
    """Counts of words met so far: sorted hashes and their counts."""

    def __init__(self, model: str):
        self.unigram = Unigram(piece_scores(model))
        self.hashes, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        data, offsets = B.utf8(texts)
        words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in B.ranges(offsets, BLOCK):
            part, edges = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, word_edges = B.word_spans(part, edges)
            value, once, which = np.unique(B.word_hashes(part, starts, ends), return_index=True, return_inverse=True)
            per = self._tokens_of(value, part.tobytes(), starts[once], ends[once])[which]
            words.append(np.diff(word_edges))
            tokens.append(np.diff(np.concatenate([[0], np.cumsum(per)])[word_edges]))
        return np.concatenate(words), np.concatenate(tokens)

    def _tokens_of(self, value: np.ndarray, whole: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.hashes) > MEMO:
            self.hashes, self.tokens = self.hashes[:0], self.tokens[:0]
        at = np.searchsorted(self.hashes, value)
        known = np.zeros(len(value), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == value[inside]
        new = np.flatnonzero(~known)
        if len(new):
            spelt = [MARK + whole[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            counts = self.unigram.counts(spelt)
            self.hashes = np.insert(self.hashes, at[new], value[new])
            self.tokens = np.insert(self.tokens, at[new], [counts[w] for w in spelt])
            at = np.searchsorted(self.hashes, value)
        return self.tokens[at]


_loaded: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """docs with _words and _tokens (long): white-space separated words, and tokens of the unigram model.

    model is the path of a sentencepiece file. Each word is segmented with the
    word mark before it. Null and empty texts have 0 of both. All rows and columns
    stay, repeated ones too; columns _words and _tokens are replaced.
    """
    plain = docs.drop("_words", "_tokens")
    B.narrow_batches(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _loaded:
            _loaded[model] = Counter(model)
        for batch in batches:
            words, tokens = _loaded[model].count(pc.fill_null(batch["text"], ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(tokens)], names=[*batch.schema.names, "_words", "_tokens"])

    return plain.mapInArrow(B.lean_batches(scan), T.StructType([*plain.schema.fields, T.StructField("_words", T.LongType()), T.StructField("_tokens", T.LongType())]))
