"""Plain versions of the operators, straight from their definitions, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def op1(rows, size=13):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < d:
                gone.update(range(j, j + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def op2(rows, size=100):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for j in range(len(b) - size + 1):
            key = b[j : j + size]
            first[key] = min(first.get(key, (d, j)), (d, j))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if first[b[j : j + size]] < (d, j):
                gone[j : j + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out)


def op3(rows, benchmark, size=10):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = ALNUM.findall(lower(text or ""))
        for j in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[j : j + size])].add(str(item))
    out = []
    for d, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, items = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    items |= found
                    hit.update(range(j, j + k))
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out)


def _spans(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op4(rows):
    assign = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    kinds, out = ["assign", "access", "hex"], []
    for d, t in rows:
        t = t or ""
        s = [("assign", *m.span()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
        s += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        s += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
        s.sort(key=lambda x: (x[1], kinds.index(x[0])))
        out.append((d, *[sum(x[0] == k for x in s) for k in kinds], sha(_spans(s))))
    return sorted(out)


def op6(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        often = set()
        for i in range(len(w) - 2):
            if times[tuple(w[i : i + 3])] > 1:
                often.update((i, i + 1, i + 2))
        failed = len(w) < 50 or 100 * len(often) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(often), failed))
    return sorted(out)


def _luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * v, 10)) for v in d[1::2])) % 10 == 0


def op8(rows):
    kinds, out = ["email", "ip", "card", "phone"], []

    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    for d, t in rows:
        t = t or ""
        s = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        s += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        s += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and _luhn(digits(m.group()))]
        s += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
        s.sort(key=lambda x: (kinds.index(x[0]), x[1]))
        out.append((d, *[sum(x[0] == k for x in s) for k in kinds], sha(_spans(s))))
    return sorted(out)


def op10(rows, size=5, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in held[x])
        for x in s:
            held[x].append(i)
        for j, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c) and find(i) != find(j):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
