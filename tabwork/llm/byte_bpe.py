"""Ids of a byte-level BPE tokenizer for whole columns: each distinct pre-token of a block is encoded once."""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa

from tabwork.llm import blocks as B

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
# fixed values: characters that the pre-token pattern takes as white space
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: the pre-token pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 2 << 20
MEMO = 500_000


def _classes() -> np.ndarray:
    """Class by code point up to 0xFFFF; unassigned ones and those beyond are left to the library."""
    kinds = {"L": LETTER, "N": NUMBER, "C": UNKNOWN}
    table = np.full(0x10000 + 1, UNKNOWN, np.uint8)
    for code in range(0x10000):
        category = unicodedata.category(chr(code))
        table[code] = OTHER if category in ("Cc", "Cf", "Co") else kinds.get(category[0], OTHER)
    table[list(WHITE)] = SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, and which texts have code points of no known class."""
    first_byte = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    edges = np.searchsorted(first_byte, offsets)
    kind = classes[np.minimum(code, 0x10000)]
    n = len(code)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(len(offsets) - 1, bool)
    odd = np.diff(np.concatenate([[0], np.cumsum(kind == UNKNOWN)])[edges]) > 0
    head = np.zeros(n + 1, bool)
    head[edges] = True  # the first character of a text
    head[n] = True
    tail = head[1:]  # the last one
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = np.zeros(n, bool)  # after a plain space of the same text
    blank[1:] = (code[:-1] == 0x20) & ~head[1:n]
    start = run & (space | ~blank)
    start[:-1] |= space[:-1] & ~space[1:] & ~tail[:-1]  # the last of several spaces before a word
    mark = np.flatnonzero(start & (code == 0x27) & ~tail)
    if len(mark):
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        one, two = padded[mark + 1], padded[mark + 2]
        letters = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= ~np.concatenate([tail, [True] * 3])[mark + 1]
        for at, size in ((mark[letters], 2), (mark[pair], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    begin = np.flatnonzero(start)
    byte = np.concatenate([first_byte, [len(data)]])
    return byte[begin], byte[np.concatenate([begin[1:], [n]])], odd


class ByteBPE:
    """Of a tokenizers JSON file."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"] for t in described["added_tokens"]}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in described["model"]["vocab"].items() if word not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self._forget()

    @cached_property
    def library(self):
        """The library's tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def _forget(self) -> None:
        """The pre-tokens met so far: sorted hashes, where their ids are, and the ids one after the other."""
        self.hashes = np.zeros(0, np.uint64)
        self.size, self.base = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array):
        """Per block of texts: first text, its ids one after the other, and the n + 1 offsets."""
        data, offsets = B.utf8(texts)
        for lo, hi in B.ranges(offsets, BLOCK):
            yield lo, *self._block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def _ids_of(self, value: np.ndarray, whole: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids and place in flat of the pre-tokens with these sorted hashes."""
        if len(self.hashes) > MEMO:
            self._forget()
        at = np.searchsorted(self.hashes, value)
        known = np.zeros(len(value), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == value[inside]
        new = np.flatnonzero(~known)
        if len(new):
            encode = self.encoding.encode_ordinary
            lists = [encode(whole[a:b].decode()) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            base = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))])
            self.hashes = np.insert(self.hashes, at[new], value[new])
            self.size, self.base = np.insert(self.size, at[new], size), np.insert(self.base, at[new], base)
            at = np.searchsorted(self.hashes, value)
        return self.size[at], self.base[at]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, odd = pretokens(data, offsets, self.classes)
        sums, down = B.prefix_sums(data)
        value, once, which = np.unique(B.span_hash(sums, down, starts, ends), return_index=True, return_inverse=True)
        whole = data.tobytes()
        size, base = self._ids_of(value, whole, starts[once], ends[once])
        per = size[which]
        ids = self.flat[np.repeat(base[which] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
        edges = np.concatenate([[0], np.cumsum(per)])[np.searchsorted(starts, offsets)]
        if odd.any():  # these texts go to the library as they are
            parts = [ids[edges[i] : edges[i + 1]] for i in range(len(odd))]
            for i in np.flatnonzero(odd).tolist():
                text = whole[offsets[i] : offsets[i + 1]].decode()
                parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            edges = np.cumsum([0, *map(len, parts)])
        return ids, edges


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
