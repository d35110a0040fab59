"""Benchmark decontamination by an FM-index over each training shard.

A shard is a few MB of document text as a sequence of word ids. Words that no
benchmark item has are breaks, and runs between breaks too short for any phrase
are left out, since a phrase cannot lie across them. The index of a shard is
the Burrows-Wheeler transform of its runs, sorted to the depth of the longest
phrase, as a wavelet tree of bit planes with rank counts, and the places of
every SAMPLE-th suffix. All phrases search backward together; occurrences are
found by stepping to a sampled suffix; the spans of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabwork.llm import blocks as B

WINDOW = 10
SAMPLE = 8
MOST_PHRASE_BYTES = 32 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BREAKS = np.zeros(256, bool)
BREAKS[:0x80] = True
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

SPANS = "array<struct<start:int,end:int>>"


class WaveletTree:
    """Rank of any symbol before any place, one bit plane per level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level) & 1
            counts = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(one, out=counts[1:])
            self.planes.append(counts)
            self.zeros.append(len(symbols) - int(counts[-1]))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each place."""
        low, high = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for level, (counts, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = counts[low], counts[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for counts, zeros in zip(self.planes, self.zeros, strict=True):
            one = counts[at + 1] - counts[at]
            symbol = symbol << 1 | one
            at = np.where(one == 1, zeros + counts[at], at - counts[at])
        return symbol


class FMIndex:
    """Of a text of symbols from 2 up, with 1 between runs and a single 0 at its end."""

    def __init__(self, symbols: np.ndarray, most: int):
        n, rank, reach = len(symbols), symbols.astype(np.int64), 1
        while True:  # prefix doubling until no two suffixes have one rank
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            if int(rank.max()) == n - 1:
                break
            reach *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.last = symbols[suffixes - 1].astype(np.int64)  # the Burrows-Wheeler transform
        self.tree = WaveletTree(self.last, max(1, int(most).bit_length()))
        self.before = np.zeros(most + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=most + 1), out=self.before[1:])
        self.kept = np.where(suffixes % SAMPLE == 0, suffixes, -1)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (a row of symbols, filled up to its size)."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.last), np.int64)
        for step in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > step) & (low < high))
            symbol = phrases[on, sizes[on] - 1 - step]
            low[on] = self.before[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.tree.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text, by stepping back to a sampled suffix."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.kept[at[open_]] >= 0
            out[open_[found]] = self.kept[at[open_[found]]] + steps[open_[found]]
            open_ = open_[~found]
            symbol = self.tree.access(at[open_])
            at[open_] = self.before[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
        return out


class Phrases:
    """Windows of the benchmark items, as symbols of the items' own words; one size class."""

    def __init__(self, windows: dict[tuple[int, ...], set[str]]):
        self.vocabulary = np.unique(np.array([w for p in windows for w in p], np.uint64))
        self.sizes = np.array([len(p) for p in windows], np.int64)
        self.least = int(self.sizes.min())
        self.symbols = np.zeros((len(windows), int(self.sizes.max())), np.int64)
        for i, p in enumerate(windows):
            self.symbols[i, : len(p)] = np.searchsorted(self.vocabulary, np.array(p, np.uint64)) + 2
        self.items = [sorted(x) for x in windows.values()]

    def occurrences(self, words: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word) of each occurrence in a shard."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        starts, ends = B.spans_of(self.vocabulary[at] == words, word_offsets)
        long_ = ends - starts >= self.least
        starts, size = starts[long_], (ends - starts)[long_]
        if not len(starts):
            return none, none
        slot = np.cumsum(size + 1) - 1  # of the separator after each run
        symbols, place = np.full(int(slot[-1]) + 2, 1, np.int64), np.zeros(int(slot[-1]) + 2, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[slot] = inside[-1] = False
        symbols[-1] = 0
        place[inside] = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        symbols[inside] = at[place[inside]] + 2
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        low, high = index.search(self.symbols, self.sizes)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return phrase, place[index.locate(rows)]


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    data, offsets = B.utf8(texts)
    data = LOWER[data]
    starts, ends, word_offsets = B.word_spans(data, offsets, BREAKS)
    return B.word_hashes(data, starts, ends), starts, ends, word_offsets, offsets


def _phrases(items: list[tuple], window: int) -> list[Phrases]:
    """Full windows, and apart from them the items that are shorter than a window."""
    words, _, _, edges, _ = _words(pa.array([t for _, t in items], pa.string()))
    full: dict[tuple[int, ...], set[str]] = {}
    short: dict[tuple[int, ...], set[str]] = {}
    for (item, _), a, b in zip(items, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = words[a:b].tolist()
        if len(own) >= window:
            for i in range(len(own) - window + 1):
                full.setdefault(tuple(own[i : i + window]), set()).add(str(item))
        elif own:
            short.setdefault(tuple(own), set()).add(str(item))
    return [Phrases(x) for x in (full, short) if x]


def _shard(texts: pa.Array, phrases: list[Phrases]) -> tuple:
    """Word counts, items and hit words of one shard, and its words."""
    words, starts, ends, word_offsets, offsets = _words(texts)
    hit, found = np.zeros(len(words), bool), [set() for _ in range(len(texts))]
    for group in phrases:
        phrase, at = group.occurrences(words, word_offsets)
        hit |= B.covered(at, group.sizes[phrase], len(words))
        doc = np.searchsorted(word_offsets, at, "right") - 1
        for p, d in np.unique(np.stack([phrase, doc], 1), axis=0).tolist():
            found[d].update(group.items[p])
    return word_offsets, found, hit, starts, ends, offsets


def _scan(phrases, window: int, shard_bytes: int, first: bool, cut: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _phrases(phrases, window)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            _, offsets = B.utf8(texts)
            for lo, hi in B.ranges(offsets, shard_bytes):
                part = batch.slice(lo, hi - lo)
                yield _answer(part, _shard(texts.slice(lo, hi - lo), ready), first, cut)

    return scan


def _spans_list(mask: np.ndarray, edges: np.ndarray) -> pa.Array:
    a, b = B.spans_of(mask, edges)
    own = np.searchsorted(edges, a, "right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(a - edges[own], pa.int32()), pa.array(b - edges[own], pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(edges))), pa.int32()), pairs)


def _answer(part: pa.RecordBatch, shard: tuple, first: bool, cut: bool) -> pa.RecordBatch:
    edges, found, hit, starts, ends, offsets = shard
    if not first:  # what earlier parts of the benchmark have hit
        found = [a | set(b or ()) for a, b in zip(found, part["_items"].to_pylist(), strict=True)]
        for row, spans in enumerate(part["_hits"].to_pylist()):
            for span in spans or ():
                hit[edges[row] + span["start"] : edges[row] + span["end"]] = True
    columns = dict(zip(part.schema.names, part.columns, strict=True))
    columns["_words"] = pa.array(np.diff(edges), pa.int64())
    columns["_items"] = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
    columns["_hits"] = _spans_list(hit, edges)
    if cut:
        columns["_clean"] = _without(part["text"], hit, edges, starts, ends, offsets)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _without(texts: pa.Array, hit, edges, starts, ends, offsets) -> pa.Array:
    """Texts without the merged hit spans, each from its first word up to the next word that stays."""
    a, b = B.spans_of(hit, edges)
    if not len(a):
        return texts
    data, _ = B.utf8(texts)
    doc = np.searchsorted(edges, a, "right") - 1
    until = np.where(b < edges[doc + 1], starts[np.minimum(b, len(starts) - 1)], ends[b - 1])
    keep = ~B.covered(starts[a], until - starts[a], len(data))
    sizes = np.concatenate([[0], np.cumsum(keep)])[offsets]
    text, rows = data[keep].tobytes(), texts.to_pylist()
    for d in np.unique(doc).tolist():
        rows[d] = text[sizes[d] : sizes[d + 1]].decode()
    return pa.array(rows, texts.type)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = B.CHUNK_BYTES, cut: bool = True, most_bytes: int = MOST_PHRASE_BYTES
) -> DataFrame:
    """docs with _words (count), _items (ids of items that occur), _hits (merged word spans) and, with cut, _clean.

    Words are runs of letters and digits (A-Z lower-cased) and of any other
    characters outside ASCII. A phrase is `window` consecutive words of an item,
    or a whole item of fewer words; a document word inside any occurrence is hit.
    _clean is the text without the hit spans. Null and empty texts have no words,
    items without words no phrase; a null item_id is named "None". All columns and
    rows of docs stay, repeated ones too. Columns of docs with these names are
    replaced. An empty benchmark hits nothing.

    The items reach the tasks in parts of at most `most_bytes`, one pass over the
    shards for each part; what the parts hit is merged.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") > 0)
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    out = docs.drop("_words", "_items", "_hits", "_clean")
    B.narrow_batches(docs)
    for i in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        phrases = [tuple(r) for r in own.collect()]
        kinds = {"_words": "long", "_items": "array<string>", "_hits": SPANS} | ({"_clean": "string"} if cut and i == parts - 1 else {})
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in kinds), *(f"{k} {v}" for k, v in kinds.items())])
        names = [f.name for f in out.schema if f.name not in kinds]
        out = out.mapInArrow(B.lean_batches(_scan(phrases, window, shard_bytes, i == 0, "_clean" in kinds)), schema).select(*[F.col(f"`{n}`") for n in names], *kinds)
    return out
