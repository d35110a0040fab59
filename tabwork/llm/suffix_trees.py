"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at every word that has `window` words left in its document.
Variable-length prefixes split the suffixes: a prefix of 1 word, or of 2, 4, 8
or `window` words where the shorter one has too many suffixes, until every
prefix has at most `group_suffixes`; small prefixes are packed together, so
each group of suffixes fits in one task. A group builds its subtree as sorted
paths: the edge labels from the root down to depth `window` are kept as one
64-bit path fingerprint, because the words themselves would be 80 bytes per
suffix. The suffixes below one path are the leaves below an internal node of at
least that depth, so a node with leaves of several documents is a repeat, and
runs of such nodes along a document are its maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwork.llm import blocks as B

WINDOW = 13
GROUP_SUFFIXES = 2_000_000
SLOTS = 4096
MOST_SLOTS = 1 << 22

ENTRY = "part int, chunk int, docs binary, counts binary, paths binary, places binary"
REPLY = "chunk int, places binary"
OUT = "doc_id long, n_words long, kept string, removed array<struct<start:int,end:int>>"


def depths_of(window: int) -> tuple[int, ...]:
    return tuple(d for d in (1, 2, 4, 8) if d < window) + (window,)


def _suffixes(texts: pa.Array, window: int) -> Iterator[tuple]:
    """Per block of documents: first document, bytes, spans, word offsets, window hashes, places, prefix hashes."""
    data, offsets = B.utf8(texts)
    for lo, hi in B.ranges(offsets):
        part, edges = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, word_offsets = B.word_spans(part, edges)
        paths, at, prefixes = B.windows(B.word_hashes(part, starts, ends), word_offsets, window, depths_of(window))
        yield lo, part, edges, starts, ends, word_offsets, paths, at, prefixes


def prefix_counts(docs: DataFrame, window: int, slots: int) -> list[np.ndarray]:
    """Suffixes per hashed prefix at each depth, over all documents; slots bounds what comes to the driver."""
    shift = np.uint64(64 - (slots - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = len(depths_of(window))
        total = np.zeros((depth, slots), np.int64)
        for batch in batches:
            for *_, prefixes in _suffixes(batch.column(0), window):
                for i, h in enumerate(prefixes):
                    total[i] += np.bincount((h >> shift).astype(np.int64), minlength=slots)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some], pa.int64())], ["slot", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(depths_of(window)) * slots, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return list(out.reshape(-1, slots))


def prefix_groups(counts: list[np.ndarray], most: int) -> tuple[list[np.ndarray], int]:
    """The group of each prefix by depth, -1 where a longer prefix is taken, and the number of groups."""
    maps, done, share, total = [], 0.0, 1.0, max(1, int(counts[0].sum()))
    for i, n in enumerate(counts):
        taken = np.ones(len(n), bool) if i == len(counts) - 1 else n <= most
        size = np.where(taken, n * share, 0.0)
        maps.append(np.where(taken, np.floor((done + np.cumsum(size) - size) / most), -1).astype(np.int32))
        done += float(size.sum())
        share *= float(n[~taken].sum()) / total
    return maps, int(max(m.max() for m in maps)) + 1


def _send(window: int, maps: list[np.ndarray], groups: int):
    shift = np.uint64(64 - (len(maps[0]) - 1).bit_length())

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        ids, texts = B.in_id_order(table)
        found, first = [], 0
        for lo, _, _, starts, _, word_offsets, paths, at, prefixes in _suffixes(texts, window):
            group = np.full(len(paths), -1, np.int32)
            for h, of in zip(prefixes, maps, strict=True):
                open_ = group < 0
                group[open_] = of[(h[open_] >> shift).astype(np.int64)]
            doc = lo + np.searchsorted(word_offsets, at, "right") - 1
            found.append((paths, at + first, doc, group))
            first += len(starts)
        cols = {k: [] for k in ("part", "chunk", "docs", "counts", "paths", "places")}
        if found:
            paths, at, doc, group = (np.concatenate(x) for x in zip(*found, strict=True))
            _, once = np.unique(paths, return_index=True)  # the first place, so the least document
            once.sort()
            paths, at, doc, group = paths[once], at[once], doc[once], group[once]
            order, edges = B.by_group(group, groups)
            for g in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[g] : edges[g + 1]]
                held, per = np.unique(doc[own], return_counts=True)
                cols["part"].append(g)
                cols["chunk"].append(chunk)
                cols["docs"].append(B.squeeze(ids[held]))
                cols["counts"].append(B.squeeze(per.astype(np.int32)))
                cols["paths"].append(paths[own].tobytes())
                cols["places"].append(B.squeeze(np.diff(at[own], prepend=0).astype(np.int32)))
        return pa.table(cols, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), *[(c, pa.binary()) for c in ("docs", "counts", "paths", "places")]]))

    return send


def _subtree(table: pa.Table) -> pa.Table:
    """The group's subtree: answers each chunk with the places whose path also starts in a smaller document."""
    paths, docs, sizes = [], [], []
    for d, c, p in zip(table["docs"], table["counts"], table["paths"], strict=True):
        paths.append(np.frombuffer(p.as_py(), np.uint64))
        docs.append(np.repeat(B.unsqueeze(d.as_py(), np.int64), B.unsqueeze(c.as_py(), np.int32)))
        sizes.append(len(paths[-1]))
    path, doc = np.concatenate(paths), np.concatenate(docs)
    order = np.argsort(path)
    ranked = path[order]
    node = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.minimum.reduceat(doc[order], node)
    late = np.zeros(len(path), bool)
    late[order] = doc[order] > np.repeat(least, np.diff(np.append(node, len(path))))
    edges = np.cumsum([0, *sizes])
    chunk, places = [], []
    for i, (c, at) in enumerate(zip(table["chunk"], table["places"], strict=True)):
        hit = late[edges[i] : edges[i + 1]]
        if hit.any():
            chunk.append(c.as_py())
            places.append(B.squeeze(np.cumsum(B.unsqueeze(at.as_py(), np.int32))[hit].astype(np.int32)))
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "places": pa.array(places, pa.binary())})


def _cut(window: int):
    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = B.in_id_order(docs)
        told = [B.unsqueeze(x.as_py(), np.int32) for x in replies["places"]]
        told = np.sort(np.concatenate(told)) if told else np.zeros(0, np.int32)
        blocks = list(_suffixes(texts, window))
        bounds = np.cumsum([0, *[len(b[3]) for b in blocks]])
        paths = np.concatenate([b[6] for b in blocks]) if blocks else np.zeros(0, np.uint64)
        place = np.concatenate([b[7] + f for b, f in zip(blocks, bounds, strict=False)]) if blocks else np.zeros(0, np.int64)
        doc = np.concatenate([b[0] + np.searchsorted(b[5], b[7], "right") - 1 for b in blocks]) if blocks else place
        _, once, which = np.unique(paths, return_index=True, return_inverse=True)
        late = np.isin(place[once], told)[which] if len(told) else np.zeros(len(paths), bool)
        late |= ids[doc] > ids[doc[once[which]]]
        gone = B.covered(place[late], window, int(bounds[-1]))
        n_words, kept, span_lists = [], [], []
        for (lo, part, edges, starts, ends, word_offsets, *_), first in zip(blocks, bounds, strict=False):
            out = gone[first : first + len(starts)]
            n_words.append(np.diff(word_offsets))
            kept.extend(_kept(part, edges, starts, ends, word_offsets, out))
            a, b = B.spans_of(out, word_offsets)
            own = np.searchsorted(word_offsets, a, "right") - 1
            cut_at = np.searchsorted(own, np.arange(len(word_offsets)))
            a, b = a - word_offsets[own], b - word_offsets[own]
            pairs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["start", "end"])
            span_lists.append(pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pairs))
        removed = pa.chunked_array(span_lists) if span_lists else pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        return pa.table({"doc_id": B.ids_back(ids), "n_words": pa.array(counts, pa.int64()), "kept": pa.array(kept, pa.string()), "removed": removed})

    return cut


def _kept(part, edges, starts, ends, word_offsets, gone) -> list[str]:
    """The words that stay, joined by one space, per document."""
    mask = B.covered(starts[~gone], (ends - starts)[~gone], len(part))
    joined = part.copy()
    stay = np.flatnonzero(~gone)
    doc = np.searchsorted(word_offsets, stay, "right") - 1
    link = stay[:-1][doc[:-1] == doc[1:]]  # a kept word with a later one in its document is followed by a break
    joined[ends[link]] = 0x20
    mask[ends[link]] = True
    size = np.concatenate([[0], np.cumsum(mask)])[edges]
    text = joined[mask].tobytes()
    return [text[a:b].decode() for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per document: words, the words that stay, and the removed spans of words.

    Words are runs of characters other than space and \\t to \\r. A word goes
    when a window of `window` words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. Null and empty
    texts have no words. A null doc_id counts as larger than all others; rows
    with one doc_id are one rank, so neither is an earlier copy of the other.
    Only doc_id and text are read. An empty table gives an empty result.
    """
    base, count = B.chunked(docs)
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (count * B.CHUNK_BYTES // group_suffixes).bit_length()))
    maps, groups = prefix_groups(prefix_counts(docs, window, slots), group_suffixes)
    entries = base.groupBy("chunk").applyInArrow(B.lean(_send(window, maps, groups)), ENTRY)
    replies = entries.groupBy("part").applyInArrow(B.lean(_subtree), REPLY)
    return base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(B.lean_pair(_cut(window)), OUT)
