"""Texts as byte blocks, hashes of words and windows, and exchanges of fingerprints between tasks.

The three substring and near-duplicate operators share one shape. Documents are
dealt into chunks of a few MB by a hash of doc_id. Each chunk sends compact
blobs of fingerprints to memory-sized groups; each group answers each chunk;
the chunk meets its answers by a cogroup. A fingerprint is sent once per chunk
however often the chunk holds it, so a passage that a third of all documents
share costs one entry per chunk, and no key is hot.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def narrow_batches(docs: DataFrame) -> None:
    """Arrow batches of the session hold at most BATCH_ROWS rows: texts are wide, and a Python worker holds whole batches."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The task over a group, giving its memory back after each."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            give_back()

    return run


def lean_pair(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a task over a cogroup."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            give_back()

    return run


def lean_batches(task: Callable) -> Callable:
    """The same for a task over batches, at its end."""

    def run(batches):
        yield from task(batches)
        give_back()

    return run


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) dealt by a hash of doc_id, and the number of chunks. One scan counts the bytes."""
    narrow_batches(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(count)).cast("int")
    base = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base, count


def in_id_order(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """doc_id (null: after all others) and text (null: empty) of a chunk, by doc_id and then text."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = pc.fill_null(table["doc_id"], int(NO_ID)).combine_chunks().to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), pc.fill_null(table["text"], "").combine_chunks()


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `most` bytes; a longer document is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; a document's end cuts a run."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(member)
    before[0], before[1:] = False, member[:-1]
    edges = offsets[(offsets < len(member))]
    before[edges] = False
    after = np.empty_like(member)
    after[-1], after[:-1] = False, member[1:]
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the n + 1 word offsets of the documents."""
    starts, ends = spans_of(~breaks[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i (mod 2 ** 64) for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, BLOCK_BYTES + 2)
        for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(size, factor)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 8 * BLOCK_BYTES:
        _powers.clear()  # the tables of one very long document are not kept
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code(byte) * BASE ** i, from which span_hash reads any span."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix_sums(data)
    return span_hash(sums, down, starts, ends)


def windows(word_hash: np.ndarray, word_offsets: np.ndarray, size: int, depths: tuple[int, ...] = ()) -> tuple:
    """Hashes of `size` consecutive words inside one document, their first words, and the hashes of their first d words."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in depths]
    doc = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    h, shorter = np.zeros(n, np.uint64), {}
    for i in range(size):
        h = h * BASE + word_hash[i : n + i]
        if i + 1 in depths:
            shorter[i + 1] = mixed(h[at])
    return mixed(h[at]), at, [shorter[d] for d in depths]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    change -= np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def sha256_parts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unsqueeze(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def by_group(group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by group, and the count + 1 offsets of the groups in it."""
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(count + 1))
