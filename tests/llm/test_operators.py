"""The training-data operators against plain versions: on the documents, and on edge cases."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwork.llm import (
    byte_bpe, compression, cutting_stock, deobfuscation, entropy_scan, fm_index, free_parse, license_scan, queries, signature_trees, spans, suffix_trees, trie_counts,
)

DOCS = "/root/testdata/sf0.001"
NULL_ID = (1 << 63) - 1
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def passage(seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgé", k=r.randint(1, 8))) for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, repeated rows and ids, ties, shared passages, one near copy."""
    shared, other = passage(1), passage(2, 120)
    near = other.split()
    near[60] = "changed"
    rows = [
        (5, None), (6, ""), (7, "   \n\t "), (None, shared), (None, None), (8, "one two"), (9, "One two"), (10, shared), (11, passage(3) + " " + shared),
        (11, passage(3) + " " + shared), (12, other), (13, " ".join(near)), (13, passage(4)), (14, "a" * 5000), (15, "é" * 700 + " " + other),
        (16, " ".join(passage(5, 60) for _ in range(40))), (17, passage(6, 9000)), (18, shared + "\n" + shared), (19, "<|endoftext|> \u00a0 x"), (1 << 62, other + " tail"),
    ]
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    return df, [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("chunk", "part", "kept", "removed", "ratio", "_words", "_items", "_hits", "_clean", "licenses", "secrets", "personal", "key", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df, [(NULL_ID if d is None else d, t) for d, t in rows]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, *columns):
    return sorted(tuple(NULL_ID if v is None and c in ("doc_id", "component_id") else v for c, v in zip(columns, r)) for r in df.select(*columns).collect())


def digest1(df):
    return rows_of(df.select("doc_id", "n_words", queries._span_total("removed").alias("n"), F.sha2("kept", 256).alias("h")), "doc_id", "n_words", "n", "h")


def digest2(df):
    out = df.select("doc_id", "n_bytes", queries._span_total("removed").alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h"))
    return rows_of(out, "doc_id", "n_bytes", "n", "s", "h")


@pytest.mark.parametrize("source", ["documents", "edges"])
@pytest.mark.parametrize("group", [2_000_000, 500])
def test_suffix_trees(request, source, group):
    df, rows = request.getfixturevalue(source)
    assert digest1(suffix_trees.dedup_substrings(df, group_suffixes=group)) == brute.op1(rows)


def test_prefixes_grow_where_they_are_frequent():
    counts = [np.array([90, 5, 5, 0]), np.array([60, 30, 5, 5]), np.array([25, 25, 25, 25])]
    maps, groups = suffix_trees.prefix_groups(counts, 40)
    assert (maps[0] >= 0).tolist() == [False, True, True, True]
    assert (maps[1] >= 0).tolist() == [False, True, True, True] and (maps[2] >= 0).all()
    assert groups >= 2


@pytest.mark.parametrize("source", ["documents", "edges"])
@pytest.mark.parametrize("group", [1_000_000, 50])
def test_free_parse(request, source, group):
    df, rows = request.getfixturevalue(source)
    assert digest2(free_parse.dedup_bytes(df, group_phrases=group)) == brute.op2(rows)


def test_suffix_ranks_are_suffix_order():
    text = bytes(random.Random(5).choices(b"ab", k=400))
    at = np.arange(300)
    rank = free_parse.suffix_ranks(np.frombuffer(text, np.uint8), at, 100)
    assert [text[i : i + 100] for i in np.argsort(rank, kind="stable")] == sorted(text[i : i + 100] for i in at)
    twice = np.frombuffer(text[:150] * 2, np.uint8)
    rank = free_parse.suffix_ranks(twice, np.array([3, 153, 4]), 100)
    assert rank[0] == rank[1] != rank[2]


@pytest.mark.parametrize("source", ["documents", "edges"])
@pytest.mark.parametrize("most", [1 << 25, 2000])
def test_fm_index(spark, request, source, most):
    df, rows = request.getfixturevalue(source)
    if source == "edges":
        items = [(1, passage(1)), (2, "One TWO"), (3, None), (4, ""), (None, passage(2, 30)), (5, passage(2, 30)), (5, passage(2, 30)), (6, "a" * 5000)]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
    else:
        benchmark = spark.read.parquet(f"{DOCS}/benchmark.parquet")
        items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    out = fm_index.decontaminate(df, benchmark, most_bytes=most)
    if source == "documents":
        got = rows_of(out.select("doc_id", "_words", queries._span_total("_hits").alias("n"), F.size("_items").alias("i"), F.sha2(F.array_join("_items", ","), 256).alias("h"), (F.size("_hits") > 0).alias("c")), "doc_id", "_words", "n", "i", "h", "c")
        assert got == brute.op3(rows, items)
    else:
        got = rows_of(out.select("doc_id", "_words", queries._span_total("_hits").alias("n"), F.size("_items").alias("i")), "doc_id", "_words", "n", "i")
        # a null item_id is named by its null in the list, so only the counts are compared
        assert got == sorted((d, w, h, i) for d, w, h, i, _, _ in brute.op3(rows, items))
    clean = {r["_clean"] for r in out.filter("size(_hits) > 0").select("_clean").collect()}
    again = fm_index.decontaminate(spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "doc_id long, text string"), benchmark)
    assert all(len(r["_clean"]) <= len(r["text"]) for r in again.collect())


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_entropy_scan_base(request, source):
    df, rows = request.getfixturevalue(source)
    found = entropy_scan.scan_secrets(df)
    out = found.select("doc_id", *[spans.count_of("secrets", k).alias(k) for k in ("assign", "access", "hex")], F.sha2(spans.joined("secrets", entropy_scan.KINDS, False, True), 256).alias("h"))
    assert rows_of(out, "doc_id", "assign", "access", "hex", "h") == brute.op4(rows)


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_deobfuscation_base(request, source):
    df, rows = request.getfixturevalue(source)
    found = deobfuscation.scan_personal(df)
    out = found.select("doc_id", *[spans.count_of("personal", k).alias(k) for k in deobfuscation.KINDS], F.sha2(spans.joined("personal", deobfuscation.KINDS, True, True), 256).alias("h"))
    assert rows_of(out, "doc_id", *deobfuscation.KINDS, "h") == brute.op8(rows)


def test_scans_on_random_strings():
    r = random.Random(3)
    parts = ["@", "a.b", "1.", "2.33", "255", ".", " ", "+1", "-", "(", "4111111111111111", "9", "x@y.z", "é", "٣", "_", "0007", "😀", "password", "=", '"', "AKIA", "ABCDEFGHIJKLMNOP", "tokeN: ", "deadbeef", "0123456789abcdef", "ſecret"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 14)))) for i in range(5000)]

    def digest(found, kinds, by_kind):
        own = [s for s in found if s[3]]
        own.sort(key=lambda s: (kinds.index(s[0]), s[1]) if by_kind else (s[1], kinds.index(s[0])))
        return brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b, _ in own))

    for (_, t), four, eight in zip(rows, brute.op4(rows), brute.op8(rows)):
        assert digest(entropy_scan.find_secrets(t), entropy_scan.KINDS, False) == four[-1], t
        assert digest(deobfuscation.find_personal(t), deobfuscation.KINDS, True) == eight[-1], t


@pytest.mark.parametrize("text,kind,source", [
    ("mail me: john.doe [at] mail (dot) example [dot] com now", "email", "john.doe [at] mail (dot) example [dot] com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("see j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
    ("\uff4a\uff4f\uff48\uff4e@example.com", "email", "\uff4a\uff4f\uff48\uff4e@example.com"),
    ("john dot doe at example dot com thanks", "email", "john dot doe at example dot com"),
    ("jo\u200bhn@exam\u200bple.com", "email", "jo\u200bhn@exam\u200bple.com"),
])
def test_disguised_identifiers_map_back(text, kind, source):
    assert [(k, text[a:b]) for k, a, b, _ in deobfuscation.find_personal(text)] == [(kind, source)]


@pytest.mark.parametrize("text", ["look at it and dot the i", "we were at one two three", "meet at ten", "un punto (at) all"])
def test_clean_text_has_no_identifier(text):
    assert deobfuscation.find_personal(text) == []


def test_mask_merges_touching_spans():
    spans_ = [{"kind": "phone", "start": 5, "end": 12}, {"kind": "card", "start": 6, "end": 20}]
    assert deobfuscation.mask("call +1 4111111111111 x", spans_) == "call <PHONE>1 x"
    assert deobfuscation.mask(None, []) is None


def test_entropy_by_counts_equals_entropy_by_definition():
    r = random.Random(8)
    for _ in range(50):
        text = bytes(r.choices(b"abc0123456789", k=r.randint(20, 60)))
        windows = [i for i in range(len(text) - 19) if -sum(c / 20 * np.log2(c / 20) for c in np.unique(list(text[i : i + 20]), return_counts=True)[1]) >= 3.2]
        want = set().union(*[range(i, i + 20) for i in windows]) if windows else set()
        got = set().union(*[range(a, b) for a, b in entropy_scan.entropy_spans(text, 20, 3.2)], set())
        assert got == want


@pytest.mark.parametrize("text,found", [
    ("key 9fA3kLz8Qw2XvB7nTy5Rm1Pd0 end", True), ("550e8400-e29b-41d4-a716-446655440000", False), ("path/to/some/file_name_with_words-2024", False),
    ("averyveryverylongwordthatisjustletters", False), ("11112222333344445555666677778888", False),
])
def test_entropy_allow_list(text, found):
    assert any(k == "entropy" for k, *_ in entropy_scan.find_secrets(text)) == found


def test_patience_alignment():
    a, b = "the x b c d q the end".split(), "the a b c d e the end".split()
    code = {w: i for i, w in enumerate({*a, *b})}
    pairs = license_scan.patience([code[w] for w in a], [code[w] for w in b])
    assert [a[i] for i, _ in pairs] == "the b c d the end".split()
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_licenses(spark, edges):
    head = license_scan.TEMPLATES["MIT-text"].split()
    altered = " ".join(w for i, w in enumerate(head) if i % 12 != 5)
    rows = [(1, f"{passage(1)} {license_scan.TEMPLATES['GPL-3.0']} {passage(2)}"), (2, passage(3) + " " + altered), (3, passage(4, 3000)), (4, None), (5, " ".join(head[:40]))]
    found = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["license"], s["coverage"], s["start"], s["end"]) for s in found[1]] == [("GPL-3.0", 1.0, 40, 52)]
    assert [s["license"] for s in found[2]] == ["MIT-text"] and 0.85 < found[2][0]["coverage"] < 1
    assert found[3] == found[4] == found[5] == []
    assert all(r["licenses"] == [] for r in license_scan.scan_licenses(edges[0]).collect())


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_compression_base(request, source):
    df, rows = request.getfixturevalue(source)
    out = compression.rated(df)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(out, *columns) == brute.op6(rows)
    assert out.filter("base_failed and kept").count() == 0


def test_compression_bands(spark):
    r = random.Random(4)
    words = [passage(i, 1) for i in range(400)]
    line = " ".join(r.choice(words) + str(i) for i in range(60))
    noise = " ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(120))
    texts = [(1, passage(7, 600)), (2, "\n".join(line[:-1] + chr(97 + i % 26) + f" {i}" for i in range(30))), (3, noise)]
    out = {x["doc_id"]: x for x in compression.rated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[1]["verdict"] == "keep" and out[2]["kept"] is False and out[2]["ratio"] < 0.2
    assert compression.band(100)[0] > compression.band(100_000)[0]


def test_bpe_equals_library():
    model, library = byte_bpe.ByteBPE(BPE), Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    r = random.Random(2)
    letters = list(" \n\t  ''strevmdlLa\u00e91\u00b2,.! \u3000\u4e00\u2167\u0301😀\u200d\u0378\r\x1c\x85")
    texts = ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(5000)] + ["<|endoftext|>", "", "'s", "it's we'll they've I'd I'm re're ''s 's ' 't"]
    got = []
    for _, ids, cut in model.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_packing_round_trip(request, source):
    df, rows = request.getfixturevalue(source)
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces = cutting_stock.pack(df, BPE).collect()
    want = sum(len(x) for own in ids.values() for x in own)
    assert sum(p["length"] for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        own = ids[NULL_ID if p["doc_id"] is None else p["doc_id"]]
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in own)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * want / 1024 + 2


def test_column_generation_meets_demand():
    r = np.random.default_rng(1)
    lengths = np.arange(1, 65)
    demand = r.integers(1, 500, 64).astype(float)
    basis, used = cutting_stock.column_generation(lengths, demand, 128)
    assert np.allclose(basis @ used, demand) and (lengths @ basis <= 128).all()
    assert used.sum() <= 1.01 * (lengths @ demand) / 128
    histogram = {int(k): int(n) for k, n in zip(lengths, demand)}
    plan = cutting_stock.Plan(histogram | {128: 7}, 128)
    filled = np.zeros(plan.sequences, int)
    for k, n in (histogram | {128: 7}).items():
        sequence, _ = plan.place(k, np.arange(n))
        np.add.at(filled, sequence, k)
    assert (filled > 0).all() and (filled <= 128).all()


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_trie_counts(request, source):
    df, rows = request.getfixturevalue(source)
    scores = trie_counts.piece_scores(PIECES)
    unknown, memo = min(scores.values()) - 10, {}

    def tokens(word):
        if word not in memo:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                size = len(word[end - 1].encode())
                ways = [(best[end - 1][0] + unknown * size, -best[end - 1][1] - size)]
                ways += [(best[a][0] + scores[word[a:end]], -best[a][1] - 1) for a in range(max(0, end - 40), end) if word[a:end] in scores]
                top = max(ways)
                best.append((top[0], -top[1]))
            memo[word] = best[-1][1]
        return memo[word]

    want = sorted((d, len(w), sum(tokens("\u2581" + x) for x in w)) for d, w in ((d, brute.WORD.findall(t or "")) for d, t in rows))
    assert rows_of(trie_counts.token_counts(df, PIECES), "doc_id", "_words", "_tokens") == want


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_signature_trees(request, source):
    df, rows = request.getfixturevalue(source)
    assert rows_of(signature_trees.ngram_join(df), "doc_id", "n_shingles", "component_id") == brute.op10(rows)


def test_large_components_are_cut_into_blocks(documents, monkeypatch):
    df, rows = documents
    monkeypatch.setattr(signature_trees, "BLOCK_SHINGLES", 300)
    assert rows_of(signature_trees.ngram_join(df, group_shingles=1000), "doc_id", "n_shingles", "component_id") == brute.op10(rows)


def test_tree_join_equals_all_pairs():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 1 << 62, r.integers(5, 200), dtype=np.uint64))
        sets += [np.unique(np.where(r.random(len(base)) < p, r.integers(0, 1 << 62, len(base), dtype=np.uint64), base)) for p in (0, 0.02, 0.08, 0.12, 0.3)]
    label = signature_trees.linked_groups(sets, 75)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    assert all((label[i] == label[j]) == (find(i) == find(j)) for i in range(len(sets)) for j in range(i))


def test_empty_tables(spark, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    outs = [
        suffix_trees.dedup_substrings(nothing), free_parse.dedup_bytes(nothing), fm_index.decontaminate(nothing, benchmark), entropy_scan.scan_secrets(nothing),
        license_scan.scan_licenses(nothing), compression.rated(nothing), cutting_stock.pack(nothing, BPE), deobfuscation.masked(nothing),
        trie_counts.token_counts(nothing, PIECES), signature_trees.ngram_join(nothing),
    ]
    assert [o.count() for o in outs] == [0] * 10


def test_every_text_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_trees.dedup_substrings(df).select(queries._span_total("removed").alias("n_removed")).collect()] == [0, 0]
    assert rows_of(signature_trees.ngram_join(df), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]
    assert digest2(free_parse.dedup_bytes(df)) == brute.op2([(1, None), (2, None)])


def test_names_of_queries():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
