"""Packing of tokenized documents into sequences as a cutting-stock problem.

Documents longer than a sequence are cut into full sequences and a rest, and a
rest longer than half a sequence into a half and what is over: rests of at most
half a sequence leave the program enough patterns to fill nearly every one. The
rests are counted by length class (`grain` tokens), a fixed number of counters
whatever the corpus.
Column generation solves the linear program over patterns (how many rests of
each length one sequence holds): a simplex master on the histogram, priced by
the knapsack over lengths with the duals as values. Counts are rounded down,
and the few rests over are placed best fit decreasing. A rest finds its sequence
by its rank among the rests of its length: ranks are numbered per bucket of
documents and shifted by the counts of the earlier buckets, so neither the
pieces nor one frequent length ever meet in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwork.llm import blocks as B
from tabwork.llm.byte_bpe import byte_bpe
from tabwork.session import cut_lineage

CAPACITY = 1024
END_ID = 0
GRAIN = 4
TOLERANCE = 1e-3
COLUMNS = 8
MOST_ROUNDS = 2000
BUCKET_PIECES = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, slot long"


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the item last added there (-1: none)."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    lengths, values = lengths[order], values[order]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + values[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], item[c] = gain[j], order[j]
    return best, item


def _pattern(c: int, best: np.ndarray, item: np.ndarray, lengths: np.ndarray) -> list[int]:
    out = []
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            out.append(int(item[c]))
            c -= int(lengths[item[c]])
    return out


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one column each) and how often each is used, meeting the demand exactly.

    Stops when the number of sequences is within `tolerance` of the bound
    (value of the duals over the value of the best knapsack), or after
    MOST_ROUNDS knapsacks; any stop meets the demand, only the padding differs.
    """
    m = len(lengths)
    first = capacity // lengths
    exact = demand
    demand = demand * (1 + 1e-5 * np.random.default_rng(1).random(m))  # no two ratios alike, so no pivot of length 0
    basis = np.diag(first).astype(np.float64)
    inverse = np.diag(1.0 / first)
    used = demand / first
    center = lengths / capacity  # the duals of the best bound so far; at first each sequence filled to the brim
    bound = float(center @ demand)
    for _ in range(MOST_ROUNDS):
        duals = inverse.sum(axis=0)
        moved = False
        for weight in (0.9, 0.6, 0.0):  # smoothed duals do not swing; plain ones decide
            values = weight * center + (1 - weight) * duals
            best, item = _knapsack(lengths, values, capacity)
            if (reached := float(values @ demand) / max(best[capacity], 1e-12)) > bound:
                bound, center = reached, values / best[capacity]
            if used.sum() <= (1 + tolerance) * bound:
                return basis, inverse @ exact
            forced = values + best[capacity - lengths]  # the best pattern with each item in it
            for i in np.argsort(-forced)[:COLUMNS].tolist():
                column = np.bincount([i, *_pattern(capacity - int(lengths[i]), best, item, lengths)], minlength=m).astype(np.float64)
                if inverse.sum(axis=0) @ column <= 1 + 1e-7:
                    continue
                step = inverse @ column
                up = step > 1e-9
                ratio = np.where(up, used / np.where(up, step, 1), np.inf)
                out = int(ratio.argmin())
                amount = ratio[out]
                used = np.maximum(used - amount * step, 0)
                used[out] = amount
                basis[:, out] = column
                row = inverse[out] / step[out]
                touched = np.flatnonzero(np.abs(step) > 1e-12)
                inverse[touched] -= np.outer(step[touched], row)
                inverse[out] = row
                moved = True
            if moved:
                break
        if not moved:
            break
    return basis, inverse @ exact


def _best_fit(rests: Counter, capacity: int) -> list[Counter]:
    """Sequences for the few rests that rounding leaves, longest first into the tightest."""
    room: list[list[Counter]] = [[] for _ in range(capacity + 1)]
    out = []
    for length in sorted(rests, reverse=True):
        for _ in range(rests[length]):
            space = next((c for c in range(length, capacity) if room[c]), capacity)
            if room[space]:
                own = room[space].pop()
            else:
                out.append(own := Counter())
            own[length] += 1
            room[space - length].append(own)
    return out


class Plan:
    """For each length class the patterns that hold it: first rank, first sequence, pieces per sequence, first slot."""

    def __init__(self, histogram: dict[int, int], capacity: int, tolerance: float = TOLERANCE):
        rests = {k: n for k, n in histogram.items() if 0 < k < capacity}
        patterns: list[tuple[dict[int, int], int]] = []
        if histogram.get(capacity):
            patterns.append(({capacity: 1}, histogram[capacity]))
        left = Counter(rests)
        if rests:
            lengths = np.array(sorted(rests))
            basis, used = column_generation(lengths, np.array([rests[k] for k in lengths.tolist()], float), capacity, tolerance)
            for j in np.flatnonzero(used >= 1 - 1e-6).tolist():
                own = {int(lengths[i]): int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}
                times = min(int(used[j] + 1e-6), *(left[k] // a for k, a in own.items()))
                if times:
                    patterns.append((own, times))
                    left.subtract({k: a * times for k, a in own.items()})
        patterns += [(own, 1) for own in _best_fit(+left, capacity)]
        rows: dict[int, list[list[int]]] = {}
        ranks: Counter = Counter()
        sequence = 0
        for own, times in patterns:
            slot = 0
            for length in sorted(own, reverse=True):
                rows.setdefault(length, []).append([ranks[length], sequence, own[length], slot])
                ranks[length] += own[length] * times
                slot += own[length]
            sequence += times
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}
        self.sequences = sequence

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the pieces of these ranks in one class."""
        first, sequence, per, slot = self.rows[length].T
        at = np.searchsorted(first, rank, "right") - 1
        inside = rank - first[at]
        return sequence[at] + inside // per[at], slot[at] + inside % per[at]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: full sequences of a document, then a half where more is left, then its rest."""
    half = capacity // 2

    B.narrow_batches(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        for batch in batches:
            doc_ids = batch["doc_id"]
            for lo, ids, edges in model.encode(batch["text"]):
                rows, starts, sizes, sums, totals = [], [], [], [], []
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    view = memoryview(own).cast("B")
                    start = 0
                    while start < len(own):
                        left = len(own) - start
                        size = capacity if left >= capacity else half if left > half else left
                        rows.append(lo + i)
                        starts.append(start)
                        sizes.append(size)
                        sums.append(zlib.crc32(view[4 * start : 4 * (start + size)]))
                        totals.append(len(own))
                        start += size
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(B.lean_batches(cut), PIECES)


def _assign(plan: Plan):
    def assign(pieces: pa.Table, earlier: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("grains", "length", "doc_id", "start", "ids_crc32")])
        grains = pieces["grains"].to_numpy()
        sequence, slot = np.zeros(len(grains), np.int64), np.zeros(len(grains), np.int64)
        before = dict(zip(earlier["own"].to_pylist(), earlier["before"].to_pylist(), strict=True))
        value, first = np.unique(grains, return_index=True)
        for k, a, b in zip(value.tolist(), first.tolist(), [*first[1:].tolist(), len(grains)], strict=True):
            sequence[a:b], slot[a:b] = plan.place(k, before[k] + np.arange(b - a))
        keep = [x.split()[0] for x in PIECES.split(", ")]
        return pieces.select(keep).append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot))

    return assign


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per piece: its document and place there, and its sequence and place there.

    A document is the ids of its text by the byte-level BPE file `tokenizer`, then
    end_id; null and empty texts are the end_id alone. Every id is in exactly one
    piece; the pieces of a sequence lie gapless from 0 and fill at most `capacity`,
    a multiple of `grain`. Rows with a null or repeated doc_id are documents of
    their own. Only doc_id and text are read. An empty table gives an empty result.
    """
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer, capacity, end_id).withColumn("grains", F.ceil(F.col("length") / F.lit(grain))))
    histogram = {r["grains"]: r["count"] for r in pieces.groupBy("grains").count().collect()}  # at most capacity / grain rows
    plan = Plan(histogram, capacity // grain, tolerance)
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    per_bucket = dealt.groupBy("grains", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("grains").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    before = per_bucket.select(F.col("grains").alias("own"), F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = dealt.groupBy("bucket").cogroup(before.groupBy("of")).applyInArrow(_assign(plan), PLACED)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` rows
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
