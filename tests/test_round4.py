"""Scale paths of the fourth round: blocks by binary search, one exchange of texts, wide kNN blocks, scores in matrices."""

from bisect import bisect_left

from pyspark.sql import functions as F

from tabwork.operators import ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_come_from_a_binary_search(spark):
    cuts = [-5, 0, 0, 3, 8, 8, 20]
    for most in (len(cuts), 1023):
        rows = spark.range(-10, 30).withColumn("cuts", F.array(*[F.lit(c).cast("long") for c in cuts]))
        made = rows.select("id", ordered._count_below(F.col("cuts"), F.col("id"), most).alias("n"))
        assert {r.id: r.n for r in made.collect()} == {i: bisect_left(cuts, i) for i in range(-10, 30)}
    blocks = ordered.with_blocks(spark.range(50), ["id"])
    assert "filter(cuts" not in plan(blocks) and "aggregate(array(" in blocks._jdf.queryExecution().analyzed().toString()


def test_phrases_and_keywords_have_one_exchange(spark):
    from tabwork.operators import textops

    texts = spark.createDataFrame([(1, "red fox runs red fox"), (2, "old sea wall"), (1, "red fox")], "k int, text string")
    for made in (textops.key_phrases(texts, "k", "text"), textops.keywords(texts, "k", "text")):
        assert plan(made).count("Exchange hashpartitioning") == 1
    assert {r.k: r.phrases[0] for r in textops.key_phrases(texts, "k", "text").collect()} == {1: "red fox", 2: "old sea"}


def test_knn_sends_rows_to_few_wide_blocks(spark, monkeypatch):
    from tabwork.operators import models

    assert models._knn_blocks(4096) == 1 and models._knn_blocks(32_768) == 8 and models._knn_blocks(1 << 20) == 32
    monkeypatch.setattr(models, "KNN_BLOCK", 4)
    rows = spark.createDataFrame([(i, [float(i), float(i % 7)], i % 3) for i in range(90)], "id long, v array<float>, y int")
    got = {r.id: r.predicted for r in models.knn(rows, rows, "id", "v", "y", 1).collect()}
    assert got == {i: float(i % 3) for i in range(90)}


def test_a_block_gives_only_the_first_rows_of_an_anchor(spark):
    import numpy as np
    import pyarrow as pa

    from tabwork.llm import hard_negatives as h

    small = np.array([[1 << 30, -5], [3, 4]])
    assert h.exact_scores(small, small).tolist() == (small.astype(object) @ small.T.astype(object)).tolist()
    asks = pa.table({"anchor_id": [100, 200], "a": [[1, 0], [2]], "windows": [[50, 60], [-3]]})
    rows = pa.table({"vec_id": [*range(90, 190), None], "v": [[i, 1] for i in range(101)]})
    first = h.best_positives(2)(asks, rows).to_pylist()
    assert [r["positive_id"] for r in first[:5]] == [None, 189, 188, 187, 186] and len(first) == 10
    other = h.best_negatives(2)(asks, rows).to_pylist()
    assert [r["negative_score"] for r in other] == [60, 59, 58, 57, 56, 50, 49, 48, 47, 46]


def test_entity_patterns_run_once_below_a_filter(spark):
    from tabwork.operators import textops

    texts = spark.createDataFrame([(1, "Ann met Bob on 1/2/2024 for $5"), (2, "Al Bo Ca. Di? Ed! Fa; Go: Hu 1/2/2024"), (3, None)], "k int, text string")
    found = textops.extract_entities(texts, "text")
    lines = found.filter(F.size("entities") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("regexp_replace") == 3
    rows = {r.k: [(e.type, e.entity) for e in r.entities] for r in found.filter("k < 3").collect()}
    assert rows[1] == [("PERSON", "Ann"), ("PERSON", "Bob"), ("DATE", "1/2/2024"), ("MONEY", "$5")]
    assert [t for t, _ in rows[2]] == ["PERSON"] * 5


def test_all_queries_search_an_index_together():
    import random

    import numpy as np

    from tabwork.llm.spelling import FMIndex

    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abç", k=draw.randint(7, 9))) for _ in range(400)})
    queries = [*words[:150], "aaaaaaz", "zzzzzzz"]
    exact = np.array([len(q) - len(q) // 2 for q in queries])

    def edits(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        put = {a + c + b for a, b in cuts for c in "abç"} | {a + c + b[1:] for a, b in cuts if b for c in "abç"}
        return (put | {a + b[1:] for a, b in cuts if b}) - {w}

    at, near = FMIndex(words).one_error_each(queries, exact)
    assert len(set(zip(at.tolist(), near.tolist()))) == len(at)
    said = {(q, words[n]) for q, n in zip((queries[k] for k in at), near)}
    ends = {q: {x + q[len(q) // 2 :] for x in edits(q[: len(q) // 2])} - {q} for q in queries}
    assert said == {(q, w) for q in queries for w in words if w in ends[q]}
