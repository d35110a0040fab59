"""Disguised identifiers that meet base spans, and mixed disguises."""

import pytest

from tabwork.llm import deobfuscation


def masked(text):
    return deobfuscation.mask(text, [dict(zip(("kind", "start", "end", "base"), s)) for s in deobfuscation.find_personal(text)])


@pytest.mark.parametrize("text,want,base", [
    ("see j\u043ehn@example.com now", "see <EMAIL> now", "hn@example.com"),
    ("see \uff4a\uff4fhn@example.com now", "see <EMAIL> now", "hn@example.com"),
    ("see jo\u200bhn@example.com now", "see <EMAIL> now", "hn@example.com"),
    ("see john@example.c\u043em now", "see <EMAIL> now", "john@example.c"),
    ("call +1 555 123 456\uff17 now", "call <PHONE> now", "+1 555 123 456"),
])
def test_disguised_span_extends_a_base_span(text, want, base):
    found = deobfuscation.find_personal(text)
    assert [text[a:b] for _, a, b, own in found if own] == [base]
    assert masked(text) == want


def test_covered_disguised_span_is_dropped():
    found = deobfuscation.uncovered([("email", 2, 9), ("email", 0, 9), ("phone", 12, 20), ("phone", 11, 20)], [("email", 0, 9), ("card", 12, 20)])
    assert found == [("phone", 11, 20)]
    assert [s[3] for s in deobfuscation.find_personal("\u043e john@example.com and +1 555 123 4567")] == [True, True]


@pytest.mark.parametrize("text,kind,source", [
    ("x john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("mail john [at] example dot com", "email", "john [at] example dot com"),
    ("john at example [dot] com", "email", "john at example [dot] com"),
    ("jane dot doe [at] example [dot] com", "email", "jane dot doe [at] example [dot] com"),
    ("john@example dot com", "email", "john@example dot com"),
    ("call five five five 0123 456 ok", "phone", "five five five 0123 456"),
    ("Order 123456789, call five five five 0123 456", "phone", "five five five 0123 456"),
])
def test_mixed_disguises(text, kind, source):
    assert [(k, text[a:b]) for k, a, b, _ in deobfuscation.find_personal(text)] == [(kind, source)]


@pytest.mark.parametrize("text", ["meet me at example.com", "chapter one, 2019 10 12 2020", "a at b. dot c", "one, two or three 100 200"])
def test_prose_has_no_mixed_disguise(text):
    assert deobfuscation.find_personal(text) == []
