"""The pipeline stage by stage against plain versions, each on its own input."""

import brute
import pytest
import zstandard

import corpus_pipeline
from tabwork.llm import compression, deobfuscation

DOCS = "/root/testdata/sf0.001"


def rated(text):
    """The verdict of the quality rules from their definition."""
    raw, c = (text or "").encode(), zstandard.ZstdCompressor(level=compression.LEVEL)
    _, *_, failed = brute.op6([(0, text)])[0]
    if failed:
        return False
    low, high = [(a, b) for start, a, b in compression.BANDS if start <= len(raw)][-1]
    parts = [raw[i : i + compression.CHUNK] for i in range(0, len(raw), compression.CHUNK)]
    ratios = [len(c.compress(p)) / len(p) for p in parts if 2 * len(p) >= compression.CHUNK]
    a, b = compression.CHUNK_BAND
    odd = max(sum(r < a for r in ratios), sum(r > b for r in ratios))
    return low <= len(c.compress(raw)) / len(raw) <= high and 100 * odd <= compression.MOST_ODD_CHUNKS * len(ratios)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{DOCS}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DOCS).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality(steps):
    before = texts(steps[0])
    assert texts(steps[1]) == {d: t for d, t in before.items() if rated(t)}


def test_near_duplicates(steps):
    before = texts(steps[1])
    heads = {d for d, _, c in brute.op10(list(before.items())) if d == c}
    assert texts(steps[2]) == {d: before[d] for d in heads}


def test_decontamination(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{DOCS}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(steps[2]), texts(steps[3])
    hits = {r[0]: r for r in brute.op3(list(before.items()), items)}
    for d, t in before.items():
        if not hits[d][5]:
            assert after[d] == t
        else:
            left = brute.ALNUM.findall(after.get(d, ""))
            assert len(left) == hits[d][1] - hits[d][2]


def test_personal_data(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    for d, t in before.items():
        found = deobfuscation.find_personal(t)
        assert (after[d] == t) == (not found)
        assert sum(brute.op8([(d, after[d])])[0][1:5]) == 0
    lengths = {r["doc_id"]: r["n_chars"] for r in steps[4].select("doc_id", "n_chars").collect()}
    assert all(lengths[d] == len(t) for d, t in after.items())


def test_packing_covers_every_document(steps):
    pieces = steps[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in pieces} == set(texts(steps[4]))
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_run_equals_the_stages(spark, steps):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DOCS).select(columns).collect())) == sorted(map(tuple, steps[5].select(columns).collect()))
