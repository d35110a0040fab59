"""Secret scan: fixed patterns, and sliding windows of Shannon entropy over candidate strings.

A candidate is a maximal run of characters that keys are made of. Its windows
slide by one character with counts kept up to date, so each step costs two
table look-ups whatever the window's size. The threshold depends on the
character class of the candidate; windows over it merge into spans. Strings of
the allow-list (words, numbers, UUIDs, paths of words and the like) are left.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from tabwork.llm.spans import Span, code_points, with_spans

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# fixed values: least entropy in bits per character over a window, by character class
THRESHOLDS = (
    ("hex", re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z"), 2.9),
    ("base32", re.compile(rb"[A-Z2-7=]+\Z"), 3.4),
    ("alphanumeric", re.compile(rb"[A-Za-z0-9]+\Z"), 3.6),
    ("base64", re.compile(rb"[A-Za-z0-9+/_=-]+\Z"), 3.8),
)
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
# fixed values: strings that are no secrets
ALLOWED = tuple(re.compile(p) for p in (
    rb"[0-9_=+/-]+\Z",
    rb"[A-Za-z]+\Z",
    rb"[+/_=-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[+/_=-]*\Z",
    rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z",
    rb"(?i).*(?:example|placeholder|xxxxxx|abcdef0?1234|0123456789)",
))

ASSIGN = re.compile(
    rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(rb"[0-9a-f]{32,}")


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Leftmost matches of each pattern, those that are too short dropped."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(raw) if len(m.group(1)) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    # a maximal run of 32 characters or more is a match of the pattern that is not dropped
    return found + [("hex", *m.span()) for m in HEX_LONG.finditer(raw)]


def entropy_spans(text: bytes, window: int, least: float) -> list[tuple[int, int]]:
    """Merged windows of at least `least` bits per character, by counts kept up to date."""
    size = min(window, len(text))
    part = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    limit = (math.log2(size) - least) * size + 1e-9
    counts = [0] * 256
    total = 0.0  # of c * log2(c) over the counts c of the window
    out: list[tuple[int, int]] = []
    for i, new in enumerate(text):
        if i >= size:
            old = text[i - size]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        c = counts[new]
        total += part[c + 1] - part[c]
        counts[new] = c + 1
        if i >= size - 1 and total <= limit:
            start = i - size + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def method_spans(raw: bytes, taken: list[tuple[str, int, int]], window: int) -> list[tuple[str, int, int]]:
    out = []
    for m in CANDIDATE.finditer(raw):
        text = m.group()
        if any(a.match(text) for a in ALLOWED):
            continue
        least = next(bits for _, kind, bits in THRESHOLDS if kind.match(text))
        for a, b in entropy_spans(text, window, least):
            a, b = a + m.start(), b + m.start()
            if not any(s < b and a < e for _, s, e in taken):
                out.append(("entropy", a, b))
    return out


def find_secrets(text: str, window: int = WINDOW) -> list[Span]:
    raw = text.encode()
    base = base_spans(raw)
    marked = sorted([(a, b, kind, True) for kind, a, b in base] + [(a, b, kind, False) for kind, a, b in method_spans(raw, base, window)])
    points = code_points(raw, len(raw) == len(text), [(a, b) for a, b, _, _ in marked])
    return [(kind, a, b, own) for (a, b), (_, _, kind, own) in zip(points, marked, strict=True)]


def scan_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `secrets`: array of (kind, start, end, base) in code points, end exclusive.

    Kinds assign, access and hex are the fixed patterns (base); entropy spans are
    added where they meet no fixed one. Null and empty texts have none. All rows
    and columns stay, repeated ones too; a column `secrets` is replaced.
    """
    return with_spans(docs, "secrets", lambda text: find_secrets(text, window))
