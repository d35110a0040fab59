"""Spelling variants: near words by bidirectional FM-index search schemes over the delimited vocabulary.

The vocabulary is built with Spark functions only: runs of letters, the crc32 rule
that deletes one code point of some runs, distinct words of MIN_LENGTH or more code
points that occur at least twice, with their counts n.

Two words are near when one edit (insert, delete or replace one code point) turns
one into the other. If q has length m, split it into q1 = q[:m//2] and q2 = q[m//2:];
a near word t is q1 followed by a word one edit from q2, or a word one edit from q1
followed by q2 (pigeonhole). The two searches of the scheme:

* right: backward search of `|` q2 exactly in the FM-index of the delimited vocabulary
  `|w1|w2|...|`, then extend leftwards over q1 allowing one error, then `|`;
* left: the same in the FM-index of the reversed vocabulary with the reversed word,
  so q1 is matched exactly and the search extends rightwards over q2.

Together the two indexes are the bidirectional index of the scheme. Intervals are
suffix-rank intervals; a rank is a binary search in the sorted positions of a code
point in the Burrows-Wheeler string. A final interval's suffix-array entries give the
words.

All queries of a group are searched together, one code point a round, on arrays of
intervals.

Spark deals the search: a near word t of q ends with the last three code points of q
(right search) or starts with its first three (left search), since both halves hold
three or more. Each (search, three code points) is one group of targets and queries
(groups of few words share an index of about PACK_WORDS words);
a group of more than GROUP_WORDS words is cut into p parts by a hash of the word,
both as targets and as queries, and each of the p x p cells (target part, query
part) is one task, so no task holds more than about GROUP_WORDS targets and as
many queries while every pair is still met. Pairs are then joined with counts,
forms are picked by one aggregation, roots are found by repeated joins (each step at
least multiplies n by ten, so the number of steps is logarithmic).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabwork.session import cut_lineage

MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
KEY_LENGTH = 3
GROUP_WORDS = 40_000  # targets indexed by one task at most
PACK_WORDS = 2000  # a key of so many words shares an index with others, about so many in all
LEAST_PACKS = 64
QUERIES = 2048  # searched together
DELIMITER = "\x01"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of MIN_LENGTH or more code points occurring MIN_COUNT or more times.

    A null text has no runs; a null doc_id is written as an empty string in the hash key.
    Counting is a partial aggregation before the shuffle, so a frequent word is no hot key.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0)).alias("_run"))
    low = F.translate("_run", _UPPER, _LOWER)
    h = F.crc32(F.concat(F.coalesce(F.col("_id"), F.lit("")), F.lit(":"), low))
    cut = (h % F.length(low)).cast("int")
    word = F.when(h % 31 == 0, F.concat(low.substr(F.lit(1), cut), low.substr(cut + 2, F.length(low)))).otherwise(low)
    words = runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (numpy sorts); the end of the text is smaller than any code."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = codes.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        sa = np.lexsort((second, rank))
        keys_r, keys_s = rank[sa], second[sa]
        new = np.empty(n, np.int64)
        new[sa] = np.concatenate(([0], np.cumsum((keys_r[1:] != keys_r[:-1]) | (keys_s[1:] != keys_s[:-1]))))
        rank = new
        if rank.max() == n - 1 or k >= n:
            return sa
        k *= 2


class FMIndex:
    """FM-index of `|w1|w2|...|`: ranks by binary search in the sorted (symbol, place) pairs of the BWT."""

    def __init__(self, words: list[str]) -> None:
        text = DELIMITER + DELIMITER.join(words) + DELIMITER
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.sa = suffix_array(codes)
        bwt = codes[(self.sa - 1) % len(codes)]
        self.bwt = bwt
        self.symbols, self.bwt = np.unique(bwt, return_inverse=True)  # the BWT as places in the sorted symbols
        order = np.argsort(self.bwt, kind="stable")
        self.size = len(codes)
        self.keys = self.bwt[order] * (self.size + 1) + order  # (symbol, place), sorted: a step is one binary search
        self.delimiter = int(np.searchsorted(self.symbols, ord(DELIMITER)))
        self.starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]  # place of the delimiter before each word

    def step(self, c, lo, hi):
        """Intervals of c + (the strings of [lo, hi)), for arrays of symbols and intervals."""
        base = np.asarray(c) * (self.size + 1)
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def preceding(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol) for the symbols before the strings of each interval, other than the delimiter.

        An interval longer than the alphabet gets all symbols; a step by one that does not occur is empty.
        """
        count, width = len(self.symbols), hi - lo
        short, long = np.flatnonzero(width <= count), np.flatnonzero(width > count)
        which, places = _spread(lo[short], hi[short])
        pairs = np.unique(short[which] * count + self.bwt[places])
        at = np.concatenate((pairs // count, np.repeat(long, count)))
        c = np.concatenate((pairs % count, np.tile(np.arange(count), len(long))))
        keep = c != self.delimiter
        return at[keep], c[keep]

    def one_error_each(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers with `|word|` = `|` + (one edit of the loose part) + exact part + `|`.

        exact holds the lengths of the queries' exact parts, which are their ends and are matched first,
        backwards. All queries move together, one code point a round.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        codes = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).astype(np.int64)
        found = np.searchsorted(self.symbols, codes)
        known = self.symbols[np.minimum(found, len(self.symbols) - 1)] == codes
        ids, ends = np.where(known, found, -1), np.cumsum(sizes)

        def move(q, t, lo, hi):
            """Intervals after the t-th code point of each query from its end; empty for one that no word has."""
            c = ids[ends[q] - 1 - t]
            a, b = self.step(np.maximum(c, 0), lo, hi)
            return a, np.where(c < 0, a, b)

        q = np.arange(len(queries))
        lo, hi = (np.full(len(queries), int(x)) for x in self.step(self.delimiter, 0, self.size))
        for t in range(int(exact.max(initial=0))):
            more = exact[q] > t
            lo[more], hi[more] = move(q[more], t, lo[more], hi[more])
            alive = lo < hi
            q, lo, hi = q[alive], lo[alive], hi[alive]
        t, err, hits = exact[q], np.zeros(len(q), bool), []
        while len(q):
            ended = t == sizes[q]
            last = ended & err
            ends_q, (a, b) = q[last], self.step(self.delimiter, lo[last], hi[last])
            hits.append((ends_q, a, b))
            open_ = np.flatnonzero(~err)  # one error may still come: another code point here
            at, c = self.preceding(lo[open_], hi[open_])
            at = open_[at]
            a, b = self.step(c, lo[at], hi[at])
            some = a < b
            at, c, a, b = at[some], c[some], a[some], b[some]
            out = ended[at]
            hits.append((q[at[out]], *self.step(self.delimiter, a[out], b[out])))
            at, c, a, b = at[~out], c[~out], a[~out], b[~out]
            other = ids[ends[q[at]] - 1 - t[at]] != c
            on = np.flatnonzero(~ended)
            x, y = move(q[on], t[on], lo[on], hi[on])
            same = x < y
            gap = np.flatnonzero(~ended & ~err)
            rounds = [
                (q[on][same], t[on][same] + 1, x[same], y[same], err[on][same]),
                (q[gap], t[gap] + 1, lo[gap], hi[gap], np.ones(len(gap), bool)),  # the word lacks this code point
                (q[at], t[at], a, b, np.ones(len(at), bool)),  # the word has one more code point here
                (q[at][other], t[at][other] + 1, a[other], b[other], np.ones(int(other.sum()), bool)),  # a replaced one
            ]
            q, t, lo, hi, err = (np.concatenate(x) for x in zip(*rounds))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, a, b = (np.concatenate(x) for x in zip(*hits))
        which, places = _spread(a, b)
        words = np.searchsorted(self.starts, self.sa[places], side="right") - 1
        pairs = np.unique(who[which] * len(self.starts) + words)
        return pairs // len(self.starts), pairs % len(self.starts)

    def one_error(self, exact: list[int], loose: list[int]) -> set[int]:
        """The words of one query, given as code points of its exact and its loose part."""
        query = "".join(map(chr, [*loose, *exact]))
        return set(self.one_error_each([query], np.array([len(exact)]))[1].tolist())


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval number, place) for every place of the intervals."""
    width = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), width)
    return which, np.arange(len(which)) + np.repeat(lo - (np.cumsum(width) - width), width)


def _search(part: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of one cell: its targets indexed, its queries searched by the cell's scheme, QUERIES at a time."""
    reverse = bool(part["_reverse"].iloc[0])
    targets = part.loc[part["_target"], "word"].tolist()
    queries = part.loc[~part["_target"], "word"].tolist()
    left, right = [], []
    if targets and queries:
        flip = (lambda w: w[::-1]) if reverse else (lambda w: w)
        index = FMIndex([flip(w) for w in targets])
        for i in range(0, len(queries), QUERIES):
            some = queries[i : i + QUERIES]
            sizes = np.array([len(q) for q in some], np.int64)
            exact = sizes // 2 if reverse else sizes - sizes // 2  # reversed q1 (left) or q2 (right)
            at, near = index.one_error_each([flip(q) for q in some], exact)
            left += [some[k] for k in at.tolist()]
            right += [targets[k] for k in near.tolist()]
    return pd.DataFrame({"word": pd.Series(left, dtype=object), "near": pd.Series(right, dtype=object)})


def near_pairs(vocab: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near): ordered pairs of vocabulary words one edit apart, each once."""
    spark = vocab.sparkSession
    sides = []
    for reverse in (False, True):
        key = F.substring("word", 1, KEY_LENGTH) if reverse else F.expr(f"substring(word, -{KEY_LENGTH}, {KEY_LENGTH})")
        keyed = vocab.select("word", F.lit(reverse).alias("_reverse"), key.alias("_key"))
        sides.append(keyed)
    keyed = sides[0].unionByName(sides[1])
    sizes = keyed.groupBy("_reverse", "_key").agg(F.count(F.lit(1)).alias("_size"))  # at most two rows per three code points
    parts = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(group_words))).cast("int")
    keyed = keyed.join(F.broadcast(sizes), ["_reverse", "_key"]).withColumn("_parts", parts)
    # keys of few words share an index; a near word still has the key of its query
    packs = max(LEAST_PACKS, vocab.count() // PACK_WORDS)
    pack = F.concat(F.lit(DELIMITER), F.pmod(F.xxhash64("_key"), F.lit(packs)).cast("string"))
    keyed = keyed.withColumn("_key", F.when(F.col("_size") <= PACK_WORDS, pack).otherwise(F.col("_key")))
    cells = F.sequence(F.lit(0), F.col("_parts") - 1)
    # a cell (target part, query part) holds at most about group_words targets and as many queries
    targets = keyed.select("word", "_reverse", "_key", F.pmod(F.xxhash64("word"), F.col("_parts")).alias("_t"), F.explode(cells).alias("_q"), F.lit(True).alias("_target"))
    queries = keyed.select("word", "_reverse", "_key", F.explode(cells).alias("_t"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("_parts")).alias("_q"), F.lit(False).alias("_target"))
    found = targets.unionByName(queries).groupBy("_reverse", "_key", "_t", "_q").applyInPandas(_search, "word string, near string")
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, by repeated joins until no root moves."""
    step = forms.select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    current = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        moved = current.join(step, current["root"] == step["_at"], "left")
        nxt = moved.select("word", F.coalesce("_next", "root").alias("root"), (F.col("_next").isNotNull()).alias("_moved"))
        nxt = cut_lineage(nxt)
        if not nxt.where("_moved").limit(1).count():
            return nxt.drop("_moved")
        current = nxt.drop("_moved")


def spelling_variants(docs: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every vocabulary word.

    form: the near word of largest n (ties: smallest in code-point order) when its n is at
    least FORM_RATIO times the word's, else null; root: forms followed to the last (the word
    itself without a form). Empty or null texts add no words; an empty table gives no rows.
    Only doc_id and text are read, so other columns of any name do not clash.
    """
    vocab = cut_lineage(vocabulary(docs.select("doc_id", "text")))
    pairs = near_pairs(vocab, group_words)
    counted = pairs.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("_near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_near_n")).alias("m"), F.col("near").alias("w"))).alias("_best"))
    rows = vocab.join(best, "word", "left")
    is_form = F.col("_best").isNotNull() & (-F.col("_best.m") >= FORM_RATIO * F.col("n"))
    forms = cut_lineage(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("_best.w")).alias("form"), F.when(is_form, -F.col("_best.m")).cast("long").alias("form_n"),
    ))
    roots = _roots(forms.select("word", "form"))
    return forms.join(roots, "word").select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")
