"""Personal data by offset-preserving deobfuscation.

Base identifiers are found in the text as it is. For disguised ones a chain of
transducers rewrites the text: look-alike characters to ASCII, invisible ones
to nothing, bracketed or spelled "at" and "dot" to @ and ., spelled digits to
digits. Every rewritten character keeps the source span that it came from, so
what the detectors find in the normal form maps back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabwork.llm import blocks as B
from tabwork.llm.spans import Span, code_points, with_spans

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9][0-9.]*")
IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: letters that look like ASCII ones
LOOK_ALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "ı": "i", "ℓ": "l",
}
# fixed values: characters without width
INVISIBLE = "­​‌‍⁠﻿"
# fixed values: spelled digits
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "(?:" + "|".join(DIGITS) + ")"
SPELLED = re.compile(rf"(?i)(?<![A-Za-z])(?:plus[ ,.-]+)?{_WORD}(?:[ ,.-]{{1,3}}{_WORD}){{6,}}(?![A-Za-z])")
AT = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-])[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?(?=[A-Za-z0-9])")
DOT = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-])[ ]?[\[({<][ ]?(?:dot|punkt|point|punto|\.)[ ]?[\])}>][ ]?(?=[A-Za-z0-9])")
_AT, _DOT = r"(?:[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?)", r"(?:[ ]?[\[({<][ ]?(?:dot|punkt|point|punto|\.)[ ]?[\])}>][ ]?| dot )"
# an address whose at and dots are each plain, bracketed or spelled; behind a spelled at one dot of the domain is not plain
ADDRESS = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9._%+-]++){{0,8}}"
    rf"(?:(?:{_AT}|@)[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++){{1,8}}| at [A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{0,8}}{_DOT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++){{0,8}})"
)
ADDRESS_PART = re.compile(rf"(?i)(?P<at>{_AT}| at )|{_DOT}")
# digit words and figures in one run
MIXED = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[ ,.()-]{{1,3}}|\+[ (]?)?(?:{_WORD}|[0-9]+)(?:[ ,.()-]{{1,3}}(?:{_WORD}|[0-9]+))+(?![A-Za-z0-9])")
TOKEN = re.compile(r"(?i)[a-z]+|[0-9]+|\+")
LEAST_DIGIT_WORDS = 3  # fewer beside figures are prose; a spelled plus counts as two
BRACKET_HINT = re.compile(rb"[\[({<] ?(?:at|@|dot|punkt|point|punto|\.) ?[\])}>]")
_WORDS = "|".join(DIGITS).encode()
# a run of seven spelled digits has one between two separators, with another behind it
DIGIT_HINT = re.compile(rb"[ ,.()-](?:" + _WORDS + rb")[ ,.()-]{1,3}(?:[0-9]|(?:" + _WORDS + rb")[ ,.()-])")
# of words and figures in one run, a word stands beside a figure
FIGURE_HINT = re.compile(rb"[0-9][ ,.()-]{1,3}(?:" + _WORDS + rb")[ ,.()-]")
# the first bytes of characters from U+0100 on, and the soft hyphen: all keys of TABLE and INVISIBLE
ODD_BYTES = re.compile(rb"[\xc4-\xff]|\xc2\xad")


def _table() -> dict[int, str]:
    out = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for low, high in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x24B6, 0x24EA), (0x2460, 0x2469)):  # wide, mathematical and circled forms
        for code in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii():
                out[code] = plain
    for code in range(0x660, 0x966):
        if unicodedata.category(chr(code)) == "Nd":
            out[code] = str(unicodedata.digit(chr(code)))
    return out


TABLE = _table()
ODD = re.compile("[" + "".join(map(re.escape, map(chr, TABLE))) + INVISIBLE + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(raw: bytes) -> list[tuple[int, int]]:
    """Each @ with local characters before it and a domain behind it, not before the last match's end."""
    out, free, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > free and raw[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = raw.find(b"@", free)
    return out


def _is_ip(text: bytes) -> bool:
    parts = [p.lstrip(b"0") for p in text.split(b".")]
    return all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts)


def _digits(text: bytes) -> str:
    return "".join(chr(c) for c in text if 0x30 <= c <= 0x39)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind, failing ones dropped."""
    found = [("email", a, b) for a, b in _emails(raw)]
    for run in DOTTED.finditer(raw):  # a match lies inside one run of digits and dots
        if run.end() - run.start() >= 7:
            found += [("ip", run.start() + m.start(), run.start() + m.end()) for m in IP.finditer(run.group()) if _is_ip(m.group())]
    for m in CARD.finditer(raw):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(raw) if 9 <= len(_digits(m.group())) <= 15]


class Traced:
    """A rewritten text; starts and ends give the source span of each of its characters (None: itself)."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def translate(self, table: dict[int, str]) -> None:
        self.text = self.text.translate(table)

    def rewrite(self, pattern: re.Pattern, new: Callable[[re.Match], str]) -> None:
        """Replace each match; the new characters share the match's source span."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            put = new(m)
            a, b = m.span()
            starts += [*self._source(at, a)[0], *[self._source(a, a + 1)[0][0]] * len(put)]
            ends += [*self._source(at, a)[1], *[self._source(b - 1, b)[1][0]] * len(put)]
            parts += [self.text[at:a], put]
            at = b
        if at:
            starts += self._source(at, len(self.text))[0]
            ends += self._source(at, len(self.text))[1]
            self.text, self.starts, self.ends = "".join(parts) + self.text[at:], starts, ends

    def _source(self, a: int, b: int) -> tuple[list[int], list[int]]:
        if self.starts is None:
            return list(range(a, b)), list(range(a + 1, b + 1))
        return self.starts[a:b], self.ends[a:b]

    def back(self, a: int, b: int) -> tuple[int, int]:
        return self._source(a, a + 1)[0][0], self._source(b - 1, b)[1][0]


def _spelled(m: re.Match) -> str:
    words = re.findall(r"[a-z]+", m.group().lower())
    return ("+" if words[0] == "plus" else "") + "".join(DIGITS[w] for w in words if w in DIGITS)


def _number(tokens: list[str]) -> str | None:
    """What a run of digit words and figures is."""
    words = sum(t in DIGITS for t in tokens) + 2 * ("plus" in tokens)
    digits = "".join(DIGITS.get(t, t) for t in tokens if t not in ("plus", "+"))
    if words < LEAST_DIGIT_WORDS or all(t in DIGITS or t == "plus" for t in tokens):  # words alone are SPELLED
        return None
    return "card" if 13 <= len(digits) <= 19 and luhn(digits) else "phone" if 9 <= len(digits) <= 15 else None


def mixed_numbers(text: str) -> list[tuple[str, int, int]]:
    """Numbers of digit words and figures; where a whole run is none, figures at its ends are left out."""
    out = []
    for m in MIXED.finditer(text):
        parts = list(TOKEN.finditer(m.group()))
        tokens = [p.group().lower() for p in parts]
        spelled = [i for i, t in enumerate(tokens) if not t[0].isdigit()]
        if not spelled or len(spelled) == len(tokens):
            continue
        for i, j in ((0, len(tokens)), (spelled[0], len(tokens)), (0, spelled[-1] + 1), (spelled[0], spelled[-1] + 1)):
            kind = _number(tokens[i:j])
            if kind:
                out.append((kind, m.start() + parts[i].start(), m.start() + parts[j - 1].end()))
                break
    return out


def disguised_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Identifiers of the normal form, as spans of the source."""
    odd = ODD_BYTES.search(raw) and ODD.search(text)
    low = raw.lower()
    hinted = b" dot " in low and (b" at " in low or b"@" in low) or BRACKET_HINT.search(low) or DIGIT_HINT.search(low) or FIGURE_HINT.search(low)
    if not odd and not hinted:
        return []
    traced = Traced(text)
    if odd:
        traced.translate(TABLE)
        traced.rewrite(re.compile(f"[{INVISIBLE}]+"), lambda m: "")
    found = []
    for m in SPELLED.finditer(traced.text):
        digits = _spelled(m).lstrip("+")
        kind = "card" if 13 <= len(digits) <= 19 and luhn(digits) else "phone" if 9 <= len(digits) <= 15 else None
        if kind:
            found.append((kind, *traced.back(*m.span())))
    found += [(kind, *traced.back(a, b)) for kind, a, b in mixed_numbers(traced.text)]
    traced.rewrite(SPELLED, _spelled)
    traced.rewrite(ADDRESS, lambda m: ADDRESS_PART.sub(lambda p: "@" if p.group("at") else ".", m.group()))
    for part in (AT, DOT):
        traced.rewrite(part, lambda m, put="@" if part is AT else ".": put)
    normal = traced.text.encode()
    spans = sorted((a, b, kind) for kind, a, b in base_spans(normal))
    points = code_points(normal, len(normal) == len(traced.text), [(a, b) for a, b, _ in spans])
    found += [(kind, *traced.back(a, b)) for (a, b), (_, _, kind) in zip(points, spans, strict=True)]
    return found


def uncovered(disguised: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The disguised spans that no base span of their kind and no other disguised span covers."""
    out, reach, far = [], dict.fromkeys(KINDS, -1), -1
    for a, b, own, kind in sorted([(a, -b, False, kind) for kind, a, b in base] + [(a, -b, True, kind) for kind, a, b in disguised]):
        if own and -b > max(reach[kind], far):
            out.append((kind, a, -b))
            far = -b
        elif not own:
            reach[kind] = max(reach[kind], -b)
    return out


def find_personal(text: str) -> list[Span]:
    raw = text.encode()
    base = sorted((a, b, kind) for kind, a, b in base_spans(raw))
    points = code_points(raw, len(raw) == len(text), [(a, b) for a, b, _ in base])
    out = [(kind, a, b, True) for (a, b), (_, _, kind) in zip(points, base, strict=True)]
    return out + [(kind, a, b, False) for kind, a, b in uncovered(disguised_spans(text, raw), [s[:3] for s in out])]


def scan_personal(docs: DataFrame) -> DataFrame:
    """docs with `personal`: array of (kind, start, end, base) in code points, end exclusive.

    Base spans are email, ip, card and phone as written; the others are disguised
    ones that no base span of their kind covers. Null and empty texts have none. All rows and
    columns stay, repeated ones too; a column `personal` is replaced.
    """
    return with_spans(docs, "personal", find_personal)


def mask(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span, and those it touches, as the name of its first kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of scan_personal replaced in text by its kind, for example <EMAIL>."""
    found = scan_personal(docs)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(t, s) for t, s in zip(batch["text"].to_pylist(), batch["personal"].to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["personal"])

    return found.mapInArrow(B.lean_batches(rewrite), docs.drop("personal").schema)
