"""HTML extraction, spelling variants and hard negatives against plain versions and edge cases."""

import html as htmllib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.llm import hard_negatives, html_text, queries, spelling

DOCS = "/root/testdata/sf0.001"


# ---- op11: HTML extraction -------------------------------------------------------------

def brute_article(page):
    """Plain version for pages with one article: its text without tags, ad blocks and asides."""
    if not page:
        return ""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", page)
    body = re.sub(r"(?s)<!--.*?-->", " ", body)
    m = re.search(r"(?is)<article\b[^>]*>(.*)</article>", body)
    if not m:
        return None
    inner = re.sub(r"(?is)<(aside|nav|footer|header|form)\b.*?</\1>", " ", m.group(1))
    inner = re.sub(r"<[^>]+>", " ", inner)
    return " ".join(htmllib.unescape(inner).split())


def test_op11_matches_plain_version(spark):
    pages = spark.read.parquet(f"{DOCS}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    want = {r["page_id"]: brute_article(r["html"]) for r in pages.collect()}
    assert set(got) == set(want)
    for pid, text in want.items():
        assert got[pid]["text"] == text
        assert got[pid]["n_chars"] == len(text)


def test_op11_blocks_edge_cases():
    assert html_text.page_blocks(None) == [] and html_text.page_blocks("") == []
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body>'
        '<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1>'
        '<p>One&nbsp;two\n\t three<br>four</p><aside>side</aside><section class="comments"><p>reply</p></section>'
        '<!-- hidden --><p>last <a href="x">link</a></p></article><footer>foot</footer></body></html>'
    )
    blocks = html_text.page_blocks(page)
    main = [b["text"] for b in blocks if b["zone"] == "main"]
    assert main == ["Title & more", "One two three four", "last link"]
    assert {b["text"] for b in blocks if b["zone"] == "boiler"} == {"We use cookies", "side", "reply", "foot"}
    last = blocks[[b["text"] for b in blocks].index("last link")]
    assert last["density"] == 0.5


def test_op11_edge_rows(spark):
    rows = [
        (1, "u1", None), (2, "u2", ""), (3, "u3", "<p>no article here at all, just a paragraph of words.</p>"), (None, "u4", "<article><p>x</p></article>"),
        (5, None, "<article><p>" + "word " * 20000 + "</p></article>"), (5, None, "<article><p>" + "word " * 20000 + "</p></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("blocks", F.lit(1))
    got = html_text.extract_text(pages).collect()
    assert len(got) == 6
    by = [(r["page_id"], r["text"]) for r in got]
    assert (1, "") in by and (2, "") in by and (None, "x") in by
    assert [t for p, t in by if p == 5] == [" ".join(["word"] * 20000)] * 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(empty).count() == 0


def test_op11_tree_is_fitted_and_compiled(spark):
    pages = spark.read.parquet(f"{DOCS}/pages.parquet")
    model = html_text.fit_tree(html_text.labelled_table(pages))
    assert model is not None
    table = html_text.labelled_table(pages).toPandas()
    # the compiled column gives the model's own predictions
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame(table)
    vec = VectorAssembler(inputCols=list(html_text.FEATURES), outputCol="features").transform(df)
    pred = [r["prediction"] == 1.0 for r in model.transform(vec).select("prediction").collect()]
    col = html_text.tree_column(model, F.struct(*[F.col(f) for f in html_text.FEATURES]))
    compiled = [r[0] for r in df.select(col).collect()]
    assert pred == compiled


# ---- op12: spelling variants -------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:]


def brute_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                i = h % len(low)
                low = low[:i] + low[i + 1:]
            if len(low) >= 7:
                counts[low] = counts.get(low, 0) + 1
    vocab = {w: n for w, n in counts.items() if n >= 2}
    words = sorted(vocab)
    near = {w: [] for w in words}
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    for w in words:
        for L in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [t for t in by_len.get(L, []) if one_edit(w, t)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda t: (-vocab[t], t), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None
    out = {}
    for w in words:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w] = (form[w], r, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def test_op12_fm_search_against_plain_edits():
    r = random.Random(3)
    words = sorted({"".join(r.choices("abcé", k=r.randint(7, 10))) for _ in range(400)})
    for reverse in (False, True):
        flip = (lambda w: w[::-1]) if reverse else (lambda w: w)
        index = spelling.FMIndex([flip(w) for w in words])
        for q in words[:120]:
            codes = [ord(c) for c in flip(q)]
            half = len(q) - len(q) // 2 if reverse else len(q) // 2
            got = {words[t] for t in index.one_error(codes[half:], codes[:half])}
            h = len(q) // 2
            if reverse:
                want = {t for t in words if one_edit(q, t) and t.startswith(q[:h])}
            else:
                want = {t for t in words if one_edit(q, t) and t.endswith(q[h:])}
            assert got == want, q


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 3])
def test_op12_matches_plain_version(spark, group_words):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    extra = [(None, "Colourful colourful colorful colourfull"), (900001, None), (900002, ""), (900003, "colourful " * 30 + "Colourfull")]
    rows = [tuple(r) for r in docs.collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, group_words).collect()}
    assert got == brute_variants(rows)
    assert got["colourfull"][0] == "colourful"


def test_op12_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0


# ---- op13: hard negatives -------------------------------------------------------------

def brute_negatives(rows):
    ok = []
    for vec_id, emb, label in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        lab = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        ok.append((vec_id, lab, [math.floor(256 * float(x)) for x in emb]))
    out = []
    key = lambda s, v: (-s, v is None, v if v is not None else 0)
    for aid, alab, a in ok:
        if aid is None or aid % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(a, v))
        same = sorted(((score(v), vid) for vid, lab, v in ok if lab == alab and vid != aid), key=lambda t: key(*t))[:5]
        for ps, pid in same:
            negs = sorted(((score(v), vid) for vid, lab, v in ok if lab != alab and 80 * ps <= 100 * score(v) <= 100 * ps), key=lambda t: key(*t))[:5]
            out += [(aid, pid, k + 1, nid, ps, ns) for k, (ns, nid) in enumerate(negs)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [hard_negatives.BLOCK_ROWS, 7])
def test_op13_matches_plain_version(spark, block_rows):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in emb.collect()]
    first = rows[0][1]
    rows += [
        (100000, None, 1), (100100, [float("nan")] + first[1:], 1), (100200, first, None), (100300, [None] + first[1:], 2),
        (100400, first, 3), (100500, first, 3), (100401, first, 4), (100402, first, 4),  # ties by score
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    got = sorted((tuple(r) for r in hard_negatives.mine(df, block_rows).collect()), key=str)
    assert got == brute_negatives([(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for v, e, lab in rows])


def test_op13_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).count() == 0


def test_queries_registered():
    for name in ("op11_tree_blocks", "op12_search_schemes", "op13_zone_maps"):
        assert name in queries.QUERIES
    assert "op13_zone_maps" in queries.ORACLE
