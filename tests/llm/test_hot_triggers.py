"""A common line with ever new text around it: its trigger is split, and the result stays."""

import random

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from tabwork.llm import blocks as B, free_parse, queries


def lined(n=150):
    r = random.Random(9)
    word = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    line = word(64)
    rows = [(i, word(200) + line + word(200)) for i in range(n)]
    return rows + [(n, rows[3][1][100:400]), (n + 1, rows[5][1]), (n + 2, rows[7][1] + rows[7][1])]


def digest(df):
    out = df.select("doc_id", "n_bytes", queries._span_total("removed").alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted(map(tuple, out.collect()))


def test_hot_trigger_is_split(spark):
    rows = lined()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base, count = B.chunked(df)
    hot, strings = free_parse.hot_triggers(base, count, 100, 32, 20)
    assert len(hot) >= 1 and strings > 20
    assert digest(free_parse.dedup_bytes(df, hot_phrases=20, group_phrases=1000)) == brute.op2(rows) == digest(free_parse.dedup_bytes(df))


def test_no_group_holds_a_hot_trigger():
    rows, groups = lined(), 16
    table = pa.table({"chunk": pa.array([0] * len(rows), pa.int32()), "doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
    data, offsets = B.utf8(table["text"])
    trig = free_parse.parse(data, offsets, 100, 32)[2]
    values, times = np.unique(trig, return_counts=True)
    hot = values[times > 20]

    def asked(hot):
        """Phrases with one trigger that a group asks the bytes of, at most, and the strings by group."""
        sent = free_parse._send(100, 32, groups, hot)(table)
        asks = [sum(len(B.unsqueeze(x, np.int32)) for x, k in zip(out["rows"].to_pylist(), out["kind"].to_pylist()) if k == free_parse.ASK)
                for out in (free_parse._resolve_phrases(sent.filter(pa.compute.equal(sent["part"], g)), 100) for g in range(groups))]
        strings = [len(B.unsqueeze(x, np.int32)) for x, k in zip(sent["runs"].to_pylist(), sent["kind"].to_pylist()) if k == free_parse.STRING]
        return max(asks), strings

    before, none = asked(np.zeros(0, np.uint64))
    after, strings = asked(hot)
    assert before > 30 and none == []
    assert after < before / 2 and len(strings) == groups and max(strings) < 2 * sum(strings) / groups
