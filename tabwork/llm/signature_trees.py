"""N-gram Jaccard join by signature trees, and the groups its links form.

1. Every chunk sends the fingerprints of its shingles once each; the answer is
   how many documents hold them. A document links only if shared shingles make
   up the threshold's part of its set, so most documents end here.
2. The others are the survivors. Of a survivor's set in order of (documents
   that hold the shingle, fingerprint), the first shingles, one more than a
   linked document may lack, must hold one of a partner's first shingles. The
   components of this candidate graph bound all further work.
3. A component's sets meet in one task; a large component is cut into blocks by
   size class and hash, and only blocks of classes near enough meet.
4. There a signature tree is built: a leaf holds documents of like size, a node
   the OR of their token bitmaps and their range of sizes. A dual traversal
   skips pairs of nodes whose greatest possible overlap is too small, and pairs
   that are one group already; the rest is counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tabwork.llm import blocks as B
from tabwork.operators.graph import connected_components
from tabwork.operators.lookup import attach
from tabwork.session import cut_lineage

SHINGLE = 5
PERCENT = 75
GROUP_SHINGLES = 2_000_000
ENTRY_SHINGLES = 2_000_000
PRINT_BYTES = 5
BLOCK_SHINGLES = 400_000
LEAF = 8

ENTRY = "part int, chunk int, keys binary, counts binary, held binary, prints binary"
REPLY = "part int, chunk int, hits binary, held binary"
SETS = "doc_id long, n_shingles long, key string, prints array<long>, first array<long>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and the n + 1 offsets."""
    data, offsets = B.utf8(texts)
    rows, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in B.ranges(offsets):
        part, edges = _LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, word_offsets = B.word_spans(part, edges)
        words = B.word_hashes(part, starts, ends)
        h, at, _ = B.windows(words, word_offsets, size)
        row = np.searchsorted(word_offsets, at, "right") - 1
        count = np.diff(word_offsets)
        few = np.flatnonzero((count > 0) & (count < size))  # the whole sequence is the one shingle
        whole = [int(_whole(words[word_offsets[i] : word_offsets[i + 1]])) for i in few.tolist()]
        row, h = np.concatenate([row, few]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        rows.append(lo + row[new])
        prints.append(h[new])
    row, h = np.concatenate(rows), np.concatenate(prints)
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


def _whole(words: np.ndarray) -> np.uint64:
    h = np.full(1, len(words), np.uint64)
    for w in words:
        h = h * B.BASE + w
    return B.mixed(h * B.BASE)[0]


def _keys(prints: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set: equal for equal sets."""
    out = np.zeros((len(edges) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[some, i] = np.add.reduceat(B.mixed(prints ^ np.uint64(salt)), edges[some])
    return out


def _chunk(table: pa.Table, size: int):
    """Of a chunk: ids, sets, keys, and the distinct sets in order of their first document."""
    ids, texts = B.in_id_order(table)
    prints, edges = _sets(texts, size)
    keys = _keys(prints, edges)
    _, first = np.unique(keys, axis=0, return_index=True)
    first = np.sort(first[np.diff(edges)[first] > 0])
    return ids, prints, edges, keys, first


def _gathered(prints: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows one after the other: (row, print) per shingle."""
    size = np.diff(edges)[rows]
    at = np.repeat(edges[:-1][rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(rows, size), prints[at]


def _blobs(prints: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of a chunk in the order its blobs have them: first place, times held, the blobs' edges, and for each shingle its entry."""
    value, once, which, held = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((once, value % np.uint64(groups)))
    edges = np.searchsorted((value % np.uint64(groups))[order], np.arange(groups + 1, dtype=np.uint64))
    entry = np.empty(len(value), np.int64)
    entry[order] = np.arange(len(value))
    return once[order], held[order], edges, entry[which]


def _send(size: int, groups: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, prints, edges, keys, first = _chunk(table, size)
        row, h = _gathered(prints, edges, first)
        once, held, bounds, _ = _blobs(h, groups)
        key = keys[:, 0] ^ keys[:, 1] * B.BASE
        cols = {name: [] for name in ("part", "chunk", "keys", "counts", "held", "prints")}
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[g], bounds[g + 1])
            rows, per = np.unique(row[once[own]], return_counts=True)
            short = np.ascontiguousarray((h[once[own]] // np.uint64(groups)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES]
            for name, x in (
                ("part", g), ("chunk", chunk), ("keys", key[rows].tobytes()), ("counts", B.squeeze(per.astype(np.int32))),
                ("held", B.squeeze(held[own].astype(np.int32))), ("prints", short.tobytes()),
            ):
                cols[name].append(x)
        return pa.table(cols, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), *[(c, pa.binary()) for c in list(cols)[2:]]]))

    return send


def _shared(table: pa.Table) -> pa.Table:
    """Answers each chunk with its shingles that sets of other keys hold too, and how many sets hold them.

    Inside a group PRINT_BYTES of a fingerprint are compared: a chance match
    only keeps a document for the exact steps.
    """
    prints, key, held, sizes = [], [], [], []
    for k, c, n, h in zip(table["keys"], table["counts"], table["held"], table["prints"], strict=True):
        short = np.frombuffer(h.as_py(), np.uint8).reshape(-1, PRINT_BYTES)
        whole = np.zeros((len(short), 8), np.uint8)
        whole[:, :PRINT_BYTES] = short
        prints.append(whole.view("<u8").ravel())
        key.append(np.repeat(np.frombuffer(k.as_py(), np.uint64), B.unsqueeze(c.as_py(), np.int32)))
        held.append(B.unsqueeze(n.as_py(), np.int32))
        sizes.append(len(short))
    order = np.argsort(h := np.concatenate(prints))
    h = h[order]
    node = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    times = np.diff(np.append(node, len(h)))
    del h, prints
    key = np.concatenate(key)[order]
    several = np.minimum.reduceat(key, node) != np.maximum.reduceat(key, node)
    del key
    held = np.concatenate(held)[order]
    several |= np.maximum.reduceat(held, node) > 1
    total = np.add.reduceat(held, node, dtype=np.int32)
    count = np.zeros(len(order), np.int32)
    count[order] = np.repeat(np.where(several, np.maximum(total, 2), 0).astype(np.int32), times)
    del order, held
    edges = np.cumsum([0, *sizes])
    out = {"part": [], "chunk": [], "hits": [], "held": []}
    for i, (part, chunk) in enumerate(zip(table["part"].to_pylist(), table["chunk"].to_pylist(), strict=True)):
        n = count[edges[i] : edges[i + 1]]
        hit = np.flatnonzero(n)
        if len(hit):
            for name, x in (("part", part), ("chunk", chunk), ("hits", B.squeeze(np.diff(hit, prepend=0).astype(np.int32))), ("held", B.squeeze(n[hit].astype(np.int32)))):
                out[name].append(x)
    return pa.table(out, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("hits", pa.binary()), ("held", pa.binary())]))


def _survive(size: int, percent: int, groups: int):
    def survive(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, prints, edges, keys, first = _chunk(docs, size)
        row, h = _gathered(prints, edges, first)
        n = np.diff(edges)
        names = [f"{a:016x}{b:016x}" for a, b in keys.tolist()]
        sets, firsts = [None] * len(ids), [None] * len(ids)
        if replies.num_rows and len(h):
            once, _, blobs, entry = _blobs(h, groups)
            held = np.ones(len(once), np.int64)
            for part, hits, count in zip(replies["part"].to_pylist(), replies["hits"], replies["held"], strict=True):
                held[blobs[part] + np.cumsum(B.unsqueeze(hits.as_py(), np.int32))] = B.unsqueeze(count.as_py(), np.int32)
            held = held[entry]
            bounds = np.searchsorted(row, first)
            shared = np.add.reduceat((held > 1).astype(np.int64), bounds)
            for i in np.flatnonzero(100 * shared >= percent * n[first]).tolist():
                a, b = bounds[i], bounds[i + 1] if i + 1 < len(bounds) else len(h)
                own, count = h[a:b], held[a:b]
                order = np.lexsort((own, count))[: len(own) - -(-percent * len(own) // 100) + 1]
                chosen = own[order][count[order] > 1]
                if len(chosen):
                    sets[first[i]], firsts[first[i]] = own.view(np.int64), chosen.view(np.int64)
        return pa.table({
            "doc_id": B.ids_back(ids), "n_shingles": pa.array(n, pa.int64()), "key": pa.array(names, pa.string()),
            "prints": pa.array(sets, pa.list_(pa.int64())), "first": pa.array(firsts, pa.list_(pa.int64())),
        })

    return survive


class Tree:
    """A signature tree: LEAF sets to a leaf, two nodes to a node, leaves first.

    A node holds the OR of its sets' token bitmaps, their least and greatest
    size, and the most tokens that one of its sets has in one bit.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.size = np.array([len(s) for s in sets])
        self.bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        packed = np.zeros(len(sets), np.int64)
        for i, s in enumerate(sets):
            per_bit = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
            packed[i] = per_bit.max()
            self.bitmaps[i] = np.packbits(per_bit > 0, bitorder="little").view(np.uint64)
        self.filled = np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        self.levels, level, fan = [], (self.bitmaps, self.size, self.size, packed), LEAF
        while not self.levels or len(level[1]) > 1:
            node = np.arange(0, len(level[1]), fan)
            merge = (np.bitwise_or, np.minimum, np.maximum, np.maximum)
            level = tuple(f.reduceat(x, node) for f, x in zip(merge, level, strict=True))
            self.levels.append(level)
            fan = 2


def _near(level: tuple, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs below which two sets may link: by size range, and by the greatest possible overlap.

    The common tokens of two sets lie in bits that both nodes have, and a bit has
    at most `packed` tokens of a set.
    """
    bitmap, least, most, packed = level
    keep = []
    for part in np.array_split(pairs, max(1, len(pairs) // 4096)):
        a, b = part[:, 0], part[:, 1]
        common = np.bitwise_count(bitmap[a] & bitmap[b]).sum(axis=1, dtype=np.int64) * np.minimum(packed[a], packed[b])
        near = (least[b] * percent <= 100 * most[a]) & (least[a] * percent <= 100 * most[b])
        keep.append(part[near & ((100 + percent) * common >= percent * (least[a] + least[b]))])
    return np.concatenate(keep)


def _node_pairs(tree: Tree, percent: int) -> np.ndarray:
    """Leaf pairs left by the dual traversal from (root, root) down."""
    pairs = _near(tree.levels[-1], np.zeros((1, 2), np.int64), percent)
    for level in tree.levels[-2::-1]:
        pairs = np.concatenate([np.stack([2 * pairs[:, 0] + i, 2 * pairs[:, 1] + j], 1) for i in (0, 1) for j in (0, 1)])
        pairs = pairs[(pairs[:, 0] <= pairs[:, 1]) & (pairs[:, 1] < len(level[1]))]
        pairs = _near(level, pairs, percent)
    return pairs[np.argsort(pairs[:, 1] - pairs[:, 0], kind="stable")]


def linked_groups(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[int]:
    """For each set the index of the set that names its group under links of `percent` Jaccard similarity.

    side: only sets of different sides are compared.
    """
    size = np.array([len(s) for s in sets])
    scale = np.floor(np.log(size) / np.log(100 / percent)) if percent < 100 else size
    order = np.lexsort((size, [s[0] for s in sets], scale))
    ranked = [sets[i] for i in order]
    side = np.arange(len(sets)) if side is None else side[order]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = Tree(ranked, 1 << min(13, max(8, int(2 * size.max() - 1).bit_length())))
    for a, b in _node_pairs(tree, percent).tolist():
        left, right = range(a * LEAF, min(len(sets), (a + 1) * LEAF)), range(b * LEAF, min(len(sets), (b + 1) * LEAF))
        if len({find(i) for i in left} | {find(i) for i in right}) == 1:
            continue
        x, y = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
        may = (x < y) & (side[x] != side[y])
        x, y = x[may], y[may]
        both = np.bitwise_count(tree.bitmaps[x] & tree.bitmaps[y]).sum(axis=1, dtype=np.int64)
        # each bit that the partner lacks has a token outside the overlap
        overlap = np.minimum(tree.size[x] - tree.filled[x], tree.size[y] - tree.filled[y]) + both
        overlap = np.minimum(overlap, np.minimum(tree.size[x], tree.size[y]))
        may = (100 + percent) * overlap >= percent * (tree.size[x] + tree.size[y])
        for i, j in zip(x[may].tolist(), y[may].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q and _linked(ranked[i], ranked[j], percent):
                parent[max(p, q)] = min(p, q)
    label = [0] * len(sets)
    for i, at in enumerate(order.tolist()):
        label[at] = int(order[find(i)])
    return label


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    either = len(np.unique(np.concatenate([a, b])))
    return 100 * (len(a) + len(b) - either) >= percent * either


def _join_task(percent: int):
    def join(table: pa.Table) -> pa.Table:
        out = {"key": [], "root": [], "cut": []}
        table = table.sort_by("component")
        names = table["component"].to_pylist()
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(lo, hi - lo)
            own, first = np.unique(np.array(part["key"].to_pylist(), object), return_index=True)  # a set may come from several chunks
            sets = [part["prints"][int(i)].values.to_numpy().view(np.uint64) for i in first]
            side = np.array(part["side"].to_pylist(), object)[first]
            cut = side[0] is not None
            label = linked_groups(sets, percent, None if not cut or len(set(side)) == 1 else side)
            for i, at in enumerate(label):
                if i != at:
                    out["key"].append(own[i])
                    out["root"].append(own[at])
                    out["cut"].append(cut)
        return pa.table(out, pa.schema([("key", pa.string()), ("root", pa.string()), ("cut", pa.bool_())]))

    return join


def _tasks(sets: DataFrame, components: DataFrame, percent: int, most: int) -> DataFrame:
    """(task, component, side, key, prints): small components together, large ones as pairs of blocks."""
    placed = sets.join(components, sets["key"] == components["id"]).drop("id")
    total = placed.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("_rows"))
    placed = attach(placed, total, ["component"], "_rows")
    bundles = F.greatest(F.lit(1), F.ceil(total.agg(F.sum("total").alias("all")).scalar() / F.lit(BLOCK_SHINGLES)))
    small = F.array(F.struct(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), bundles).cast("string")).alias("task"), F.lit(None).cast("string").alias("side"),
    ))
    ratio = 100 / percent * (1 + 1e-9) if percent < 100 else 1 + 1e-9
    scale = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(ratio)))
    blocks = F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    side = F.concat_ws(".", scale, own)

    def pair(c1, i, c2, j):
        return F.struct(F.concat_ws("|", "component", c1, i, c2, j).alias("task"), side.alias("side"))

    every = F.sequence(F.lit(0), blocks - 1)
    large = F.concat(
        F.transform(every, lambda j: pair(scale, F.least(own, j), scale, F.greatest(own, j))),
        F.transform(every, lambda j: pair(scale, own, scale + 1, j)),
        F.transform(every, lambda j: pair(scale - 1, j, scale, own)),
    )
    return placed.select(
        "component", "key", "prints", F.explode(F.when(F.col("total") <= most, small).otherwise(large)).alias("_t")
    ).select("component", "key", "prints", "_t.task", "_t.side")


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per document: the size of its shingle set and the least doc_id of its group of links.

    Words are runs of characters other than space and \t to \r, with A-Z
    lower-cased; a set holds the distinct runs of `shingle` words, or the whole
    text as one where it has fewer words. Two documents link when their Jaccard
    similarity is at least `percent` per cent. Null and empty texts have an empty
    set and no links; their group is their own doc_id. A null doc_id counts as
    the largest and comes back as null. Repeated rows link with each other as equal
    sets do. Only doc_id and text are read. An empty table gives an empty result.
    """
    base, count = B.chunked(docs)
    groups = max(1, -(-count * B.CHUNK_BYTES // 6 // ENTRY_SHINGLES))
    entries = base.groupBy("chunk").applyInArrow(B.lean(_send(shingle, groups)), ENTRY)
    replies = entries.groupBy("part").applyInArrow(B.lean(_shared), REPLY)
    rows = cut_lineage(base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(B.lean_pair(_survive(shingle, percent, groups)), SETS))
    heads = rows.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))

    cells = rows.filter(F.col("first").isNotNull()).select("key", F.explode("first").alias("_cell"))
    centers = cells.groupBy("_cell").agg(F.min("key").alias("_center"), F.max("key").alias("_last"), F.count(F.lit(1)).alias("_n"))
    edges = attach(cells, centers, ["_cell"], "_n").filter(F.col("_center") != F.col("key"))
    components = cut_lineage(connected_components(edges.select(F.col("_center").alias("id1"), F.col("key").alias("id2")).distinct()))

    sets = rows.filter(F.col("prints").isNotNull()).select("key", "n_shingles", "prints")
    links = cut_lineage(_tasks(sets, components, percent, group_shingles).groupBy("task").applyInArrow(B.lean(_join_task(percent)), "key string, root string, cut boolean"))
    roots = links.filter(~F.col("cut")).select("key", "root")
    cut = links.filter("cut")
    if cut.take(1):
        across = connected_components(cut.select(F.col("key").alias("id1"), F.col("root").alias("id2")))
        roots = roots.unionByName(across.select(F.col("id").alias("key"), F.col("component").alias("root")))
    named = heads.join(roots, "key", "left").withColumn("_group", F.coalesce("root", "key")).drop("root")
    least = named.groupBy("_group").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_sets"))
    named = attach(named, least, ["_group"], "_sets").select("key", "component_id", "_copies")
    out = attach(rows.select("doc_id", "n_shingles", "key"), named, ["key"], "_copies")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
