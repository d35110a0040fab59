"""Spans of kinds in texts: a column helper and the string form that queries compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwork.llm import blocks as B

ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SPARK = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
]))
Span = tuple[str, int, int, bool]


def with_spans(docs: DataFrame, name: str, find: Callable[[str], list[Span]]) -> DataFrame:
    """docs with the spans that find gives for each text (null: empty), in code points, end exclusive."""
    plain = docs.drop(name)
    B.narrow_batches(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ARROW)], names=[*batch.schema.names, name])

    return plain.mapInArrow(B.lean_batches(scan), T.StructType([*plain.schema.fields, T.StructField(name, SPARK)]))


def code_points(raw: bytes, ascii_only: bool, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes, in order of their starts, as spans of code points; their ends are ASCII characters."""
    if ascii_only:
        return spans
    out, at, points = [], 0, 0
    for a, b in spans:
        points += len(raw[at:a].decode())
        out.append((points, points + b - a))
        at = a
    return out


def joined(spans: str, kinds: Sequence[str], by_kind: bool, base_only: bool) -> Column:
    """kind:start:end, comma-joined, by kind as listed then start or the other way round."""
    some = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    rank = lambda s: F.array_position(F.lit(list(kinds)), s["kind"]).cast("int")
    keyed = F.transform(some, lambda s: (
        F.struct(rank(s).alias("a"), s["start"].alias("b"), s["end"].alias("end"), s["kind"].alias("kind")) if by_kind
        else F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("end"), s["kind"].alias("kind"))
    ))
    start = "b" if by_kind else "a"
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s[start], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
