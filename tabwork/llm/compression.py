"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks, with limits by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from tabwork.llm import blocks as B

LEVEL = 3
CHUNK = 1024
LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_ODD_CHUNKS = 30
# how limits are fitted (fit): quality 1 rows in the sample, rows a length class needs, and the room left beside the sample's extremes
FIT_ROWS = 2000
LEAST_FIT_ROWS = 5
LOW_ROOM, CHUNK_LOW_ROOM, HIGH_ROOM = 0.97, 0.90, 1.25
SHORT_MOST = 0.98  # a text shorter than all of the sample may hardly compress
LONGEST = 2 << 20  # from here on zstandard's window is full, and a longer text compresses no better
# (from so many bytes on, least ratio, greatest ratio): a short text compresses less, whatever it says
BANDS = (
    (0, 0.584, 0.98), (256, 0.584, 0.885), (363, 0.528, 0.885), (512, 0.519, 0.852), (725, 0.492, 0.786), (1024, 0.476, 0.725),
    (1449, 0.465, 0.679), (2048, 0.45, 0.651), (2897, 0.441, 0.612), (4096, 0.427, 0.59), (5793, 0.414, 0.583), (8192, 0.408, 0.564),
    (11586, 0.403, 0.552), (16384, 0.391, 0.534), (23171, 0.379, 0.534), (32768, 0.368, 0.534), (46341, 0.357, 0.534), (65536, 0.346, 0.534),
    (92682, 0.336, 0.534), (131072, 0.326, 0.534), (185364, 0.316, 0.534), (262144, 0.307, 0.534), (370728, 0.297, 0.534), (524288, 0.288, 0.534),
    (741456, 0.28, 0.534), (1048576, 0.271, 0.534), (1482911, 0.263, 0.534), (2097152, 0.255, 0.534),
)
CHUNK_BAND = (0.452, 0.852)
SYMBOLS = "#*$%&|<>"

FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_low_chunks", pa.int64()), ("n_high_chunks", pa.int64()),
    ("base_failed", pa.bool_()), ("verdict", pa.string()), ("kept", pa.bool_()),
)
TYPES = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType()}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])


def _repeats(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many rows of the same document have the same key, per row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(r), np.int64)
    out[order] = np.diff(np.append(np.flatnonzero(new), len(r)))[np.cumsum(new) - 1] if len(r) else 0
    return out


def _base(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of a block of documents that need no compression."""
    n = len(edges) - 1
    starts, ends, word_edges = B.word_spans(data, edges)
    sums, down = B.prefix_sums(data)
    words = B.span_hash(sums, down, starts, ends)
    inside = B.covered(starts, ends - starts, len(data))
    h, at, _ = B.windows(words, word_edges, 3)
    row = np.searchsorted(word_edges, at, "right") - 1
    often = at[_repeats(row, h) > 1]
    # lines: from a document's start or a \n to the next \n or the document's end
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([edges[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(n), np.searchsorted(edges, breaks, "right") - 1])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.append(line_start[1:], 0)
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_end = np.where(last, edges[line_row + 1], line_end - 1)
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    key = B.span_hash(sums, down, line_start, line_end)
    distinct = np.unique(np.stack([line_row.astype(np.uint64), key]), axis=1)[0].astype(np.int64) if len(key) else line_row
    return {
        "n_words": np.diff(word_edges),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), edges),
        "n_symbols": _sums(_SYMBOL[data], edges),
        "n_dup_lines": np.bincount(line_row, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": _sums(B.covered(often, 3, len(words)), word_edges),
    }


def _base_failed(figures: dict[str, np.ndarray]) -> np.ndarray:
    return (figures["n_words"] < LEAST_WORDS) | (100 * figures["n_repeat_words"] > MOST_REPEATED * figures["n_words"])


def band(size: int, bands=BANDS) -> tuple[float, float]:
    _, low, high = max(b for b in bands if b[0] <= size)
    return low, high


def _compressed(text: memoryview, compressor: zstandard.ZstdCompressor, bands, chunk: int) -> tuple[float | None, int, int, int]:
    """Ratio of the whole text; number of chunks, and of those below and above the chunk limits. A last part under half a chunk is left out."""
    if not len(text):
        return None, 0, 0, 0
    ratio = len(compressor.compress(text)) / len(text)
    n = low = high = 0
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk]
        if 2 * len(part) < chunk:
            break
        own = len(compressor.compress(part)) / len(part)
        n, low, high = n + 1, low + (own < CHUNK_BAND[0]), high + (own > CHUNK_BAND[1])
    return ratio, n, low, high


def _judge(size: int, ratio: float | None, n: int, low: int, high: int, base_failed: bool, bands) -> str:
    if base_failed:
        return "base"
    least, most = band(size, bands)
    if ratio < least or 100 * low > MOST_ODD_CHUNKS * n:
        return "repetitive"
    if ratio > most or 100 * high > MOST_ODD_CHUNKS * n:
        return "incompressible"
    return "keep"


def fit_bands(sizes: np.ndarray, ratios: np.ndarray) -> tuple[tuple[int, float, float], ...]:
    """Limits by half octaves of length that keep all the given texts, with room beside their extremes.

    Limits fall with length. Below the sampled lengths the lower limit of the
    first class holds; above them it falls on by LOW_ROOM a class up to LONGEST.
    """
    kind = np.floor(2 * np.log2(np.maximum(sizes, 1)) + 1e-9).astype(int)
    classes = [k for k, n in zip(*np.unique(kind, return_counts=True), strict=True) if n >= LEAST_FIT_ROWS]
    if not classes:
        raise ValueError("too few texts to fit limits on")
    last = int(np.ceil(2 * np.log2(LONGEST)))
    where = np.clip(np.searchsorted(classes, kind, "right") - 1, 0, None)  # a class of few texts joins the one below
    low = np.minimum.accumulate([ratios[where == i].min() for i in range(len(classes))]) * LOW_ROOM
    high = np.maximum.accumulate([ratios[where == i].max() for i in range(len(classes))][::-1])[::-1] * HIGH_ROOM
    out = [(0, low[0], SHORT_MOST)] + [(2 ** (k / 2), a, min(b, SHORT_MOST)) for k, a, b in zip(classes, low, high, strict=True)]
    out += [(2 ** (k / 2), low[-1] * LOW_ROOM ** (k - classes[-1]), out[-1][2]) for k in range(classes[-1] + 1, last + 1)]
    return tuple((int(np.ceil(size)), round(float(a), 3), round(float(b), 3)) for size, a, b in out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chunk: int = CHUNK, level: int = LEVEL) -> tuple[tuple, tuple[float, float]]:
    """BANDS and CHUNK_BAND from at most `rows` quality 1 documents, taken by a hash of doc_id, that pass the base rule."""
    good = docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    texts = [(r["text"] or "").encode() for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    texts = [t for t, bad in zip(texts, _base_failed(_base(data, edges)), strict=True) if not bad]
    compressor = zstandard.ZstdCompressor(level=level)
    share = lambda t: len(compressor.compress(t)) / len(t)
    parts = [share(t[a : a + chunk]) for t in texts for a in range(0, len(t), chunk) if 2 * len(t[a : a + chunk]) >= chunk]
    bands = fit_bands(np.array([len(t) for t in texts]), np.array([share(t) for t in texts]))
    return bands, (round(min(parts) * CHUNK_LOW_ROOM, 3), round(min(max(parts) * HIGH_ROOM, SHORT_MOST), 3))


def rated(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """docs with the figures of FIELDS: word and line counts, compression ratios, and the verdict.

    base_failed: under 50 words, or over 50 % of the words in three-word windows
    that occur twice or more. verdict: base, repetitive, incompressible or keep;
    kept is true for keep alone. Ratios are compressed bytes over bytes of UTF-8;
    the limits of a document follow from its length. Null and empty texts have no
    words and fail. Rows stay as they are, repeated ones too; columns of docs with
    the names of FIELDS are replaced.
    """
    names = [n for n, _ in FIELDS]
    plain = docs.drop(*names)
    B.narrow_batches(docs)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            data, offsets = B.utf8(texts)
            for lo, hi in B.ranges(offsets):
                part, edges = np.ascontiguousarray(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                out = _base(part, edges)
                failed = _base_failed(out)
                view = memoryview(part)
                sizes = [_compressed(view[a:b], compressor, bands, chunk) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                verdict = [_judge(int(n), *s, bool(f), bands) for n, s, f in zip(np.diff(edges), sizes, failed, strict=True)]
                ratio, chunks, low, high = zip(*sizes, strict=True)
                out |= {"ratio": ratio, "n_chunks": chunks, "n_low_chunks": low, "n_high_chunks": high, "base_failed": failed, "verdict": verdict, "kept": [v == "keep" for v in verdict]}
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(out[n], t) for n, t in FIELDS)], names=[*own.schema.names, *names])

    schema = T.StructType([*plain.schema.fields, *(T.StructField(n, TYPES[t]) for n, t in FIELDS)])
    return plain.mapInArrow(B.lean_batches(rate), schema)
