"""Substring dedup of bytes by prefix-free parsing.

A rolling hash over `TRIGGER` bytes sets the cuts: every string of `length`
bytes has one trigger, the place of its smallest hash, so equal strings have
their trigger at the same place. Neighbouring strings with one trigger form a
phrase. The parse of the corpus is its sequence of phrases, and the dictionary
holds each distinct phrase once with its first occurrence in corpus order
(doc_id, start).

1. Every chunk sends its parse, one entry per distinct phrase: the hash of the
   trigger's bytes and of the phrase. Later occurrences of a phrase repeat in
   full. A trigger with one phrase in the whole dictionary needs no more.
2. Only phrases that share a trigger with another phrase (the ends of repeats)
   send their bytes. The suffix array of this dictionary is built by prefix
   doubling down to depth `length`; suffixes of one rank are one string, and the
   parse gives each its first occurrence in corpus order.

A trigger of very many phrases (a common line of fewer than `length` bytes with
ever new text around it) would put them all in one group. Such triggers are
counted beforehand on a sample of the chunks; their phrases are sent as single
strings, dealt by the hash of the string, each once per chunk. The result does
not depend on which triggers these are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwork.llm import blocks as B
from tabwork.session import cut_lineage

LENGTH = 100
TRIGGER = 32
GROUP_PHRASES = 1_000_000
GROUP_BYTES = 4 << 20
HOT_PHRASES = 8192
SAMPLE_CHUNKS = 16
PARSE, LATE, ASK, STRING = 0, 1, 2, 3

ENTRY = "part int, chunk int, kind int, rows binary, ids binary, counts binary, starts binary, runs binary, triggers binary, phrases binary, text binary"
REPLY = "chunk int, kind int, size int, rows binary, starts binary, runs binary"
OUT = "doc_id long, n_bytes long, kept binary, removed array<struct<start:int,end:int>>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def parse(data: np.ndarray, offsets: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """Phrases of a block: first string, number of strings, hash of the trigger, hash of the phrase."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    long_ = size >= length
    if n <= 0 or not long_.any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, down = B.prefix_sums(data)
    grams = B.mixed((sums[trigger:] - sums[:-trigger]) * down[: len(data) - trigger + 1])
    bits = np.uint64(len(data).bit_length())
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # equal hashes: the leftmost
    reach, span = length - trigger + 1, 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[reach - span : reach - span + n])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = B.covered(offsets[:-1][long_], size[long_] - length + 1, n)
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return starts, ends - starts, grams[at[starts]], B.span_hash(sums, down, starts, ends - 1 + length)


def _later(doc: np.ndarray, start: np.ndarray, doc0: np.ndarray, start0: np.ndarray) -> np.ndarray:
    return (doc > doc0) | (doc == doc0) & (start > start0)


def _firsts(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys the index of the first occurrence; (indices of the firsts, for each entry its first)."""
    order = np.lexsort((start, doc, key))
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.empty(len(key), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return order[new], first


def _pack(cols: dict, part: int, chunk: int, kind: int, ids: np.ndarray, row, start, run, trig=None, phrase=None, text: bytes = b"") -> None:
    """Append one blob of entries, which are in order of row and start."""
    held, per = np.unique(row, return_counts=True)
    for name, value in (
        ("part", part), ("chunk", chunk), ("kind", kind), ("rows", B.squeeze(held.astype(np.int32))), ("ids", B.squeeze(ids[held])),
        ("counts", B.squeeze(per.astype(np.int32))), ("starts", B.squeeze(np.diff(start, prepend=0).astype(np.int32))), ("runs", B.squeeze(run.astype(np.int32))),
        ("triggers", b"" if trig is None else trig.tobytes()), ("phrases", b"" if phrase is None else phrase.tobytes()), ("text", text),
    ):
        cols[name].append(value)


def _unpack(table: pa.Table, at: list[int]) -> tuple[np.ndarray, ...]:
    """Blob number, row, doc, start and run of the entries in blobs `at`."""
    blob, row, doc, start, run = [], [], [], [], []
    for i in at:
        per = B.unsqueeze(table["counts"][i].as_py(), np.int32)
        row.append(np.repeat(B.unsqueeze(table["rows"][i].as_py(), np.int32), per))
        doc.append(np.repeat(B.unsqueeze(table["ids"][i].as_py(), np.int64), per))
        start.append(np.cumsum(B.unsqueeze(table["starts"][i].as_py(), np.int32)).astype(np.int64))
        run.append(B.unsqueeze(table["runs"][i].as_py(), np.int32))
        blob.append(np.full(len(run[-1]), i, np.int32))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (blob, row, doc, start, run))


def hot_triggers(base: DataFrame, count: int, length: int, trigger: int, most: int) -> tuple[np.ndarray, int]:
    """Triggers of more than about `most` distinct phrases, sorted, and about how many strings they have.

    Counted on SAMPLE_CHUNKS of the chunks, which are dealt by hash. The list has
    at most one trigger for each `most` phrases of the corpus.
    """
    part = min(count, SAMPLE_CHUNKS)

    def phrases(batches):
        for batch in batches:
            data, offsets = B.utf8(batch["text"])
            for lo, hi in B.ranges(offsets):
                _, run, trig, phrase = parse(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, trigger)
                yield pa.RecordBatch.from_arrays([pa.array(trig.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(run, pa.int64())], names=["trig", "phrase", "run"])

    sample = base.filter(F.col("chunk") < part).select("text").mapInArrow(B.lean_batches(phrases), "trig long, phrase long, run long")
    once = sample.groupBy("trig", "phrase").agg(F.first("run").alias("run"))
    often = once.groupBy("trig").agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("strings")).filter(F.col("n") * count > most * part)
    rows = often.select("trig", "strings").toArrow()
    return np.sort(rows["trig"].to_numpy().astype(np.int64).view(np.uint64)), (sum(rows["strings"].to_pylist()) * count) // part


def _strings(data: np.ndarray, at: np.ndarray, run: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of phrases: number of the phrase, hash of the string."""
    sums, down = B.prefix_sums(data)
    begin = np.repeat(at, run) + _within(run)
    return np.repeat(np.arange(len(run)), run), B.span_hash(sums, down, begin, begin + length)


def _is_hot(trig: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(trig), bool)
    return hot[np.minimum(np.searchsorted(hot, trig), len(hot) - 1)] == trig


def _send(length: int, trigger: int, groups: int, hot: np.ndarray):
    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        ids, texts = B.in_id_order(table)
        data, offsets = B.utf8(texts)
        found, single = [], []
        for lo, hi in B.ranges(offsets):
            edges = offsets[lo : hi + 1] - offsets[lo]
            own = data[offsets[lo] : offsets[hi]]
            at, run, trig, phrase = parse(own, edges, length, trigger)
            row = np.searchsorted(edges, at, "right") - 1
            split = _is_hot(trig, hot)
            if split.any():
                which, string = _strings(own, at[split], run[split], length)
                single.append((lo + row[split][which], (at - edges[row])[split][which] + _within(run[split]), string))
            keep = ~split
            found.append((lo + row[keep], (at - edges[row])[keep], run[keep], trig[keep], phrase[keep]))
        cols = {name: [] for name in _schema(ENTRY).names}
        row, start, run, trig, phrase = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        if len(row):
            _, first = _firsts(phrase, ids[row], start)
            later = _later(ids[row], start, ids[row[first]], start[first])
            late, once = np.flatnonzero(later), np.flatnonzero(~later)  # rows of one doc_id may tie for the first place
            if len(late):  # repeats inside the chunk
                _pack(cols, chunk % groups, chunk, LATE, ids, row[late], start[late], run[late])
            order, edges = B.by_group((trig[once] % np.uint64(groups)).astype(np.int64), groups)
            for g in np.flatnonzero(np.diff(edges)).tolist():
                own = once[order[edges[g] : edges[g + 1]]]
                _pack(cols, g, chunk, PARSE, ids, row[own], start[own], run[own], trig[own], phrase[own])
        if single:
            _send_strings(cols, chunk, ids, *(np.concatenate(x) for x in zip(*single, strict=True)), groups)
        return pa.table(cols, _schema(ENTRY))

    return send


def _send_strings(cols: dict, chunk: int, ids: np.ndarray, row: np.ndarray, start: np.ndarray, string: np.ndarray, groups: int) -> None:
    """Strings of hot triggers by their hash, each once; repeats inside the chunk are late."""
    one = np.ones(len(row), np.int64)
    _, first = _firsts(string, ids[row], start)
    later = _later(ids[row], start, ids[row[first]], start[first])
    late, once = np.flatnonzero(later), np.flatnonzero(~later)
    if len(late):
        _pack(cols, chunk % groups, chunk, LATE, ids, row[late], start[late], one[late])
    order, edges = B.by_group((string[once] % np.uint64(groups)).astype(np.int64), groups)
    for g in np.flatnonzero(np.diff(edges)).tolist():
        own = once[order[edges[g] : edges[g + 1]]]
        _pack(cols, g, chunk, STRING, ids, row[own], start[own], one[own], phrase=string[own])


def _reply(cols: dict, table: pa.Table, kind: int, blob, row, start, run, length: int = 1) -> None:
    """One answer for each blob with entries; size counts the bytes of their phrases."""
    order, edges = B.by_group(blob, table.num_rows)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[i] : edges[i + 1]]
        for name, value in (
            ("chunk", table["chunk"][i].as_py()), ("kind", kind), ("size", int(run[own].sum() + (length - 1) * len(own))),
            ("rows", B.squeeze(row[own].astype(np.int32))), ("starts", B.squeeze(start[own].astype(np.int32))), ("runs", B.squeeze(run[own].astype(np.int32))),
        ):
            cols[name].append(value)


def _dictionary(length: int):
    """Phrases of a group of triggers: later occurrences are late; phrases that share a trigger are asked for their bytes."""

    def resolve(table: pa.Table) -> pa.Table:
        return _resolve_phrases(table, length)

    return resolve


def _resolve_phrases(table: pa.Table, length: int) -> pa.Table:
    cols = {name: [] for name in _schema(REPLY).names}
    kinds = table["kind"].to_pylist()
    blob, row, _, start, run = _unpack(table, [i for i, k in enumerate(kinds) if k == LATE])
    _reply(cols, table, LATE, blob, row, start, run)
    here = [i for i, k in enumerate(kinds) if k == PARSE]
    if here:
        blob, row, doc, start, run = _unpack(table, here)
        trig = np.concatenate([np.frombuffer(table["triggers"][i].as_py(), np.uint64) for i in here])
        phrase = np.concatenate([np.frombuffer(table["phrases"][i].as_py(), np.uint64) for i in here])
        once, first = _firsts(phrase, doc, start)
        late = _later(doc, start, doc[first], start[first])
        _reply(cols, table, LATE, blob[late], row[late], start[late], run[late])
        shared, times = np.unique(trig[once], return_counts=True)
        ask = np.flatnonzero(~late & np.isin(trig, shared[times > 1]))
        _reply(cols, table, ASK, blob[ask], row[ask], start[ask], run[ask], length)
    here = [i for i, k in enumerate(kinds) if k == STRING]
    if here:
        blob, row, doc, start, run = _unpack(table, here)
        _, first = _firsts(np.concatenate([np.frombuffer(table["phrases"][i].as_py(), np.uint64) for i in here]), doc, start)
        late = _later(doc, start, doc[first], start[first])
        _reply(cols, table, LATE, blob[late], row[late], start[late], run[late])
    return pa.table(cols, _schema(REPLY))


def _told(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and run of all answers of one kind, in order."""
    out = []
    for name in ("rows", "starts", "runs"):
        parts = [B.unsqueeze(x.as_py(), np.int32) for x, k in zip(replies[name], replies["kind"].to_pylist(), strict=True) if k == kind]
        out.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    order = np.lexsort((out[1], out[0]))
    return out[0][order], out[1][order], out[2][order]


def _spell(length: int, trigger: int, groups: int):
    def spell(docs: pa.Table, replies: pa.Table) -> pa.Table:
        cols = {name: [] for name in _schema(ENTRY).names}
        row, start, run = _told(replies, ASK)
        if len(row):
            ids, texts = B.in_id_order(docs)
            data, offsets = B.utf8(texts)
            at, size = offsets[row] + start, run + length - 1
            sent = np.repeat(at, size) + _within(size)
            text, ends = data[sent], np.cumsum(size)
            trig = _triggers(text, ends - size, length, trigger)
            order, edges = B.by_group((trig % np.uint64(groups)).astype(np.int64), groups)
            for g in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[g] : edges[g + 1]]
                part = text[np.repeat((ends - size)[own], size[own]) + _within(size[own])]
                _pack(cols, g, docs["chunk"][0].as_py(), PARSE, ids, row[own], start[own], run[own], text=part.tobytes())
        return pa.table(cols, _schema(ENTRY))

    return spell


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the lengths."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _triggers(text: np.ndarray, starts: np.ndarray, length: int, trigger: int) -> np.ndarray:
    """The trigger hash of each phrase, from its first string."""
    first = text[(starts[:, None] + np.arange(length)).ravel()]
    _, _, trig, _ = parse(first, np.arange(len(starts) + 1) * length, length, trigger)
    return trig


def suffix_ranks(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of `length` bytes at `at` by prefix doubling: equal strings, equal ranks, in byte order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(min(8, length)):
        key = (key << np.uint64(8)) | padded[i : n + i]
    rank, depth = np.unique(key, return_inverse=True)[1], min(8, length)
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64), return_inverse=True)[1]
        depth += step
    return rank[at]


def _suffix_array(length: int):
    def resolve(table: pa.Table) -> pa.Table:
        cols = {name: [] for name in _schema(REPLY).names}
        blob, row, doc, start, run = _unpack(table, list(range(table.num_rows)))
        text = np.frombuffer(b"".join(x.as_py() for x in table["text"]), np.uint8)
        size = (run + length - 1).astype(np.int64)
        inside = _within(run.astype(np.int64))
        own = np.repeat(np.arange(len(run)), run)
        rank = suffix_ranks(text, (np.cumsum(size) - size)[own] + inside, length)
        begin = start[own] + inside
        _, first = _firsts(rank, doc[own], begin)
        late = _later(doc[own], begin, doc[own[first]], begin[first])
        new = late.copy()
        new[1:] &= ~late[:-1] | (own[1:] != own[:-1])
        heads = np.flatnonzero(new)
        if len(heads):
            runs = np.add.reduceat(late.astype(np.int64), heads)  # a run of late strings ends before the next head
            _reply(cols, table, LATE, blob[own[heads]], row[own[heads]], begin[heads], runs)
        return pa.table(cols, _schema(REPLY))

    return resolve


def _cut(length: int):
    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = B.in_id_order(docs)
        data, offsets = B.utf8(texts)
        row, start, run = _told(replies, LATE)
        gone = B.covered(offsets[row] + start, run + length - 1, len(data))
        a, b = B.spans_of(gone, offsets)
        own = np.searchsorted(offsets, a, "right") - 1
        edges = np.searchsorted(own, np.arange(len(offsets)))
        pairs = pa.StructArray.from_arrays([pa.array(a - offsets[own], pa.int32()), pa.array(b - offsets[own], pa.int32())], ["start", "end"])
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        text = data[~gone].tobytes()
        parts = [text[i:j] for i, j in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        return pa.table({
            "doc_id": B.ids_back(ids), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "kept": pa.array(parts, pa.binary()),
            "removed": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs),
        })

    return cut


def dedup_bytes(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, group_phrases: int = GROUP_PHRASES, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """One row per document: bytes, the bytes that stay, and the removed byte spans.

    A byte goes when a string of `length` bytes that covers it also starts
    earlier: in a smaller doc_id, or before it in its document. Strings do not
    cross documents and are judged on the input. Null text is empty. A null
    doc_id comes after all others; of rows with one doc_id, equal starts are
    neither earlier nor later. Only doc_id and text are read. An empty table
    gives an empty result.
    """
    base, count = B.chunked(docs)
    about = count * B.CHUNK_BYTES * 2 // (length - trigger + 2)  # phrases
    hot, strings = hot_triggers(base, count, length, trigger, hot_phrases) if about > hot_phrases else (np.zeros(0, np.uint64), 0)
    groups = max(1, -(-(about + strings) // group_phrases))
    entries = base.groupBy("chunk").applyInArrow(B.lean(_send(length, trigger, groups, hot)), ENTRY)
    replies = cut_lineage(entries.groupBy("part").applyInArrow(B.lean(_dictionary(length)), REPLY))
    asked = replies.filter(F.col("kind") == ASK)
    spelt_groups = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES))
    spelt = base.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(B.lean_pair(_spell(length, trigger, spelt_groups)), ENTRY)
    ends = spelt.groupBy("part").applyInArrow(B.lean(_suffix_array(length)), REPLY)
    late = replies.filter(F.col("kind") == LATE).unionByName(ends)
    return base.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(B.lean_pair(_cut(length)), OUT)
