"""Hard negatives: Hilbert-ordered candidate blocks with per-dimension zone maps, chosen by interval bounds.

Candidates (rows with a label and a finite vector) get integer vectors
floor(256 x) and a Hilbert key over the HILBERT_DIMS dimensions of largest
variance. They are range-partitioned by (label, Hilbert key), cut into blocks of at
most BLOCK_ROWS rows of one label, and written as Parquet to the shared folder, so
a lost executor re-reads the same blocks. Each block's zone map holds its label,
row count and the minimum and maximum of every dimension.

For an anchor a and a block with bounds [lo_d, hi_d], interval arithmetic bounds
the score a.x of every row of the block: sum_d min(a_d lo_d, a_d hi_d) to
sum_d max(a_d lo_d, a_d hi_d).

* Positives: blocks of the anchor's label sorted by their lower bound; the lower
  bound T of the block where the running row count reaches POSITIVES + 1 (one for
  the anchor itself) is at most the fifth score of other rows, so only blocks
  whose upper bound reaches T are read.
* Negatives: a positive of score p opens the window 80 p <= 100 s <= 100 p; only
  blocks of other labels whose bounds meet some window of the anchor are read.

Anchors are the stated query set; they meet the zone maps chunk by chunk (a query
set against all blocks, no pairs of rows), and rows are scored only in the blocks
chosen: a block meets its anchors in one task as a matrix product, and gives on the
first rows of each anchor only. Ranking is by windows over one anchor's candidates.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwork.session import cut_lineage, shared_dir

POSITIVES = 5
NEGATIVES = 5
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
SCALE = 256
BLOCK_ROWS = 256
HILBERT_DIMS = 4
HILBERT_BITS = 8
ZONE_CHUNK = 64  # zone maps that one anchor row meets at a time
PART_ANCHORS = 8192  # anchors that meet one block in one task at most, about
FILE_ROWS = 200_000  # candidate rows per written file at most


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (after the relabel rule), v (integer vector) of the rows that take part.

    Rows with a null label, a null vector or a null or non-finite component are left out.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    ok = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long"))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


def dot(a: Column, b: Column) -> Column:
    """Integer inner product; components beyond the shorter vector count as zero."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, t: s + t)


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of coords (n x k integers in [0, 2^bits)), by Skilling's transpose."""
    x = coords.astype(np.uint64).T.copy()
    k = x.shape[0]
    m = np.uint64(1) << np.uint64(bits - 1)
    q = m
    while q > 1:
        p = q - np.uint64(1)
        for i in range(k):
            hit = (x[i] & q) != 0
            x[0] = np.where(hit, x[0] ^ p, x[0])
            t = np.where(hit, 0, (x[0] ^ x[i]) & p).astype(np.uint64)
            x[0] ^= t
            x[i] ^= t
        q >>= np.uint64(1)
    for i in range(1, k):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[k - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    for i in range(k):
        x[i] ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(k):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def _blocks(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, filled, last = 0, 0, None
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            ids = np.empty(len(labels), np.int64)
            for i, lab in enumerate(labels.tolist()):
                if filled == block_rows or (last is not None and lab != last):
                    number, filled = number + 1, 0
                ids[i] = (part << 32) | number
                filled, last = filled + 1, lab
            yield batch.append_column("block", pa.array(ids))
    return run


def candidate_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with a block id, ordered by (label, Hilbert key), written to the shared folder and read back."""
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    total = rows.count()
    chosen: list[int] = []
    if dims:
        spread = rows.agg(*[F.variance(F.col("v")[d]).alias(f"d{d}") for d in range(dims)]).first()
        chosen = sorted(range(dims), key=lambda d: (-(spread[d] or 0.0), d))[: min(HILBERT_DIMS, dims)]
    if chosen:
        edges = rows.agg(*[f(F.col("v")[d]) for d in chosen for f in (F.min, F.max)]).first()
        lows = [edges[2 * i] or 0 for i in range(len(chosen))]
        highs = [edges[2 * i + 1] or 0 for i in range(len(chosen))]
        cells = (1 << HILBERT_BITS) - 1
        cols = [
            F.least(F.lit(cells), F.greatest(F.lit(0), ((F.coalesce(F.col("v")[d], F.lit(0)) - lo) * cells / F.lit(max(hi - lo, 1))).cast("long")))
            for d, lo, hi in zip(chosen, lows, highs)
        ]

        width = len(cols)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coords = np.stack([batch.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
                key = hilbert_keys(coords, HILBERT_BITS).astype(np.int64) if len(coords) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(key)], names=["vec_id", "label", "v", "hkey"])

        with_cells = rows.select("vec_id", "label", "v", *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
        rows = with_cells.mapInArrow(keyed, "vec_id long, label long, v array<long>, hkey long")
    else:
        rows = rows.withColumn("hkey", F.lit(0).cast("long"))
    parts = max(1, math.ceil(total / FILE_ROWS))
    ordered = rows.repartitionByRange(parts, "label", "hkey", "vec_id").sortWithinPartitions("label", "hkey", "vec_id")
    blocked = ordered.mapInArrow(_blocks(block_rows), "vec_id long, label long, v array<long>, hkey long, block long")
    folder = f"{shared_dir(spark)}/hard-negative-blocks-{uuid.uuid4().hex}"
    blocked.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def zone_maps(blocks: DataFrame, dims: int) -> DataFrame:
    """block, label, rows, lo and hi arrays: the per-dimension minimum and maximum of each block."""
    lo = F.array(*[F.min(F.coalesce(F.col("v")[d], F.lit(0))) for d in range(dims)]) if dims else F.array().cast("array<long>")
    hi = F.array(*[F.max(F.coalesce(F.col("v")[d], F.lit(0))) for d in range(dims)]) if dims else F.array().cast("array<long>")
    return blocks.groupBy("block").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("rows"), lo.alias("lo"), hi.alias("hi"))


def _bound(a: Column, lo: Column, hi: Column, upper: bool) -> Column:
    pick = F.greatest if upper else F.least
    terms = F.zip_with(F.zip_with(a, lo, lambda x, y: F.struct(x.alias("a"), y.alias("l"))), hi, lambda s, h: pick(F.coalesce(s["a"], F.lit(0)) * s["l"], F.coalesce(s["a"], F.lit(0)) * h))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + F.coalesce(t, F.lit(0)).cast("long"))


def anchor_bounds(anchors: DataFrame, zones: DataFrame, chunk: int = ZONE_CHUNK) -> DataFrame:
    """anchor_id, a_label, block, b_label, rows, low, high for every anchor and block, chunk by chunk."""
    n_chunks = max(1, math.ceil(zones.count() / chunk))
    chunks = zones.withColumn("_chunk", F.pmod(F.xxhash64("block"), F.lit(n_chunks)))
    asks = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_chunk"))
    met = asks.join(chunks, "_chunk")
    return met.select(
        "anchor_id", "a_label", "a", "block", F.col("label").alias("b_label"), "rows",
        _bound(F.col("a"), F.col("lo"), F.col("hi"), False).alias("low"), _bound(F.col("a"), F.col("lo"), F.col("hi"), True).alias("high"),
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers; components beyond a shorter vector are zero."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    sizes = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


def exact_scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of v; an OverflowError beyond 64 bits."""
    if not a.size or not v.size:
        return np.zeros((len(a), len(v)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(v.min())), abs(int(v.max()))) * a.shape[1]
    if most < 1 << 53:  # every partial sum is an integer that a double holds
        return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ v.T
    return np.array([[int(x) for x in row] for row in a.astype(object) @ v.T.astype(object)], dtype=np.int64)


def _ranked(left: pa.Table, right: pa.Table, dims: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The block's rows by id (nulls last), the scores of each anchor, and each anchor's row order by score."""
    right = right.sort_by("vec_id")
    scores = exact_scores(_matrix(left.column("a"), dims), _matrix(right.column("v"), dims))
    return right, scores, np.argsort(-scores, axis=1, kind="stable")


def _taken(left: pa.Table, right: pa.Table, scores: np.ndarray, at: tuple[np.ndarray, np.ndarray], names: list[str]) -> pa.Table:
    asks, rows = at
    columns = [left.column("anchor_id").take(pa.array(asks)), right.column("vec_id").take(pa.array(rows)), pa.array(scores[asks, rows])]
    return pa.table(columns, names=names)


def best_positives(dims: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The first POSITIVES rows of one block for each anchor, other than itself."""
        right, scores, order = _ranked(left, right, dims)
        ids = right.column("vec_id").fill_null(-1).to_numpy()  # an anchor's id is never null or -1
        other = ids[order] != left.column("anchor_id").to_numpy()[:, None]
        asks, places = np.nonzero(other & (np.cumsum(other, axis=1) <= POSITIVES))
        return _taken(left, right, scores, (asks, order[asks, places]), ["anchor_id", "positive_id", "positive_score"])
    return run


def best_negatives(dims: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The first NEGATIVES rows of one block inside each window of each anchor, each row once."""
        right, scores, order = _ranked(left, right, dims)
        sorted_scores = np.take_along_axis(scores, order, 1)
        windows = left.column("windows").to_pylist()
        keep = np.zeros(scores.shape, bool)
        for i in range(max(map(len, windows), default=0)):
            top = np.array([w[i] if i < len(w) else -1 for w in windows], np.int64)[:, None]  # a window below 0 is empty
            inside = (top >= 0) & (sorted_scores <= top) & (100 * sorted_scores >= 80 * top)
            keep |= inside & (np.cumsum(inside, axis=1) <= NEGATIVES)
        asks, places = np.nonzero(keep)
        return _taken(left, right, scores, (asks, order[asks, places]), ["anchor_id", "negative_id", "negative_score"])
    return run


def score_blocks(asks: DataFrame, blocks: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """run(anchors, rows) for each block and part of its anchors: a matrix product a task, its best rows out."""
    dealt = asks.withColumn("_part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int"))
    sides = blocks.select("block", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    wanted = sides.join(dealt.select("block", "_part").distinct(), ["block", "_part"], "left_semi")
    return dealt.groupBy("block", "_part").cogroup(wanted.groupBy("block", "_part")).applyInArrow(run, schema)


def mine(embeddings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose vec_id is divisible by ANCHOR_EVERY. Positives: the first
    POSITIVES other rows of the anchor's label by score (higher first, ties by smaller
    vec_id); fewer if the label has fewer. Negatives per positive of score p: the first
    NEGATIVES rows of other labels with 80 p <= 100 s <= 100 p in the same order. Rows
    that take no part (null label, vector or component, non-finite component) are neither
    anchors nor candidates; a null vec_id is never an anchor. An empty table gives no rows.
    Only vec_id, embedding and label are read, so other columns do not clash.
    """
    rows = prepared(embeddings.select("vec_id", "embedding", "label"))
    blocks = candidate_blocks(rows, block_rows)
    dims = blocks.agg(F.max(F.size("v"))).first()[0] or 0
    zones = zone_maps(blocks, dims)
    anchors = blocks.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("vec_id", "label", "v")
    bounds = anchor_bounds(anchors, zones)
    parts = max(1, math.ceil(anchors.count() / PART_ANCHORS))

    # positives: the threshold from lower bounds, then the blocks that can reach it
    same = bounds.where(F.col("a_label") == F.col("b_label"))
    by_low = Window.partitionBy("anchor_id").orderBy(F.desc("low"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = same.withColumn("_seen", F.sum("rows").over(by_low))
    threshold = running.where(F.col("_seen") >= POSITIVES + 1).groupBy("anchor_id").agg(F.max("low").alias("_t"))
    reach = same.join(threshold, "anchor_id", "left").where(F.col("_t").isNull() | (F.col("high") >= F.col("_t")))
    scored = score_blocks(
        reach.select("anchor_id", "a", "block"), blocks, parts, best_positives(dims), "anchor_id long, positive_id long, positive_score long"
    )
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    positives = cut_lineage(scored.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= POSITIVES).drop("_r"))

    # negatives: blocks of other labels whose bounds meet a window of the anchor
    other = bounds.where(F.col("a_label") != F.col("b_label")).select("anchor_id", "a", "block", "low", "high")
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    met = lambda p: (100 * F.col("high") >= 80 * p) & (F.col("low") <= p) & (p >= 0)
    meets = other.join(windows, "anchor_id").where(F.exists("windows", met)).select("anchor_id", "a", "windows", "block").distinct()
    neg = score_blocks(meets, blocks, parts, best_negatives(dims), "anchor_id long, negative_id long, negative_score long")
    paired = positives.join(neg, "anchor_id").where(
        (80 * F.col("positive_score") <= 100 * F.col("negative_score")) & (F.col("negative_score") <= F.col("positive_score"))
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = paired.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score",
    )
