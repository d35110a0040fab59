"""Ordered computation without sending a whole key to one task.

Rows are cut into blocks of the whole order key. The cut points come from a
bounded sample of keys, so a block holds about the same number of rows whether
the rows belong to one partition key or to many; any cut points give the same
result. A window then runs inside (key, block), and the totals of the earlier
blocks, one row per key and block, are added to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

LEAST_BLOCKS = 16
SAMPLE_PER_BLOCK = 32
CHUNK_ROWS = 1_000_000


def order_key(order_by: Sequence[str]) -> Column:
    """The order columns as one struct, which compares as the columns do, nulls first."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)])


def block_count(df: DataFrame) -> int:
    return min(1024, max(LEAST_BLOCKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _cut_points(source: DataFrame, order_by: Sequence[str], parts: int) -> Column:
    """Sorted array of at most parts - 1 order keys, evenly spaced in a sample of the distinct ones.

    A row is in the sample by its hash, at a rate that gives about
    SAMPLE_PER_BLOCK keys for each block, so every evaluation has the same cuts.
    A value of the first column that very many rows share is cut by the columns
    after it.
    """
    hashed = [f.name for f in source.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    total = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = source.filter(share * total < parts * SAMPLE_PER_BLOCK).select(order_key(order_by).alias("_k"))
    keys = F.sort_array(F.collect_set("_k"))
    every = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(keys, F.floor(i * F.size(keys) / F.lit(parts)).cast("int")))
    return sample.agg(F.array_distinct(F.filter(every, lambda k: k.isNotNull())).alias("cuts")).scalar()


def _count_below(cuts: Column, key: Column, most: int) -> Column:
    """How many of at most `most` sorted cut points lie under key, by binary search: few looks a row, not one a cut."""
    steps = [1 << i for i in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda below, s: F.when(F.get(cuts, below + s - 1) < key, below + s).otherwise(below),
    )


def with_blocks(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    cut_from: DataFrame | None = None,
    name: str = "_part",
) -> DataFrame:
    """Add a struct (partition keys, block); blocks rise with the whole order key."""
    source, parts = (cut_from if cut_from is not None else df), block_count(df)
    cut = df.withColumn("_cuts", _cut_points(source, order_by, parts))
    block = _count_below(F.col("_cuts"), order_key(order_by), parts)
    part = F.struct(*[F.col(c) for c in partition_by], block.cast("long").alias("_block"))
    return cut.withColumn(name, part).drop("_cuts")


def running(
    df: DataFrame,
    columns: dict[str, tuple[str, str]],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    totals: dict[str, tuple[str, str]] | None = None,
    cut_from: DataFrame | None = None,
) -> DataFrame:
    """Running sum, count, min and max: columns maps output name to (input, how).

    totals adds the same figures over the whole partition key.
    """
    totals = totals or {}
    make = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    parts = with_blocks(df, order_by, partition_by, cut_from)
    inside = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select(
        "*", *[make[how](F.col(c)).over(inside).alias(f"_in_{out}") for out, (c, how) in columns.items()]
    )
    every = {**columns, **totals}
    sums = parts.groupBy("_part").agg(*[make[how](F.col(c)).alias(f"_sum_{o}") for o, (c, how) in every.items()])
    # one row per key and block, so this window holds at most the block count per key
    keys = [F.col(f"_part.{c}") for c in partition_by]
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part._block").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    before = sums.select(
        "_part",
        *[merge[how](F.col(f"_sum_{o}")).over(earlier).alias(f"_before_{o}") for o, (_, how) in columns.items()],
        *[merge[how](F.col(f"_sum_{o}")).over(whole).alias(o) for o, (_, how) in totals.items()],
    )
    joined = local.join(before, "_part", "left")
    out = []
    for o, (_, how) in columns.items():
        here, prior = F.col(f"_in_{o}"), F.col(f"_before_{o}")
        if how in ("sum", "count"):
            both = F.when(here.isNull() & prior.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
            )
        else:
            both = F.greatest(here, prior) if how == "max" else F.least(here, prior)
        out.append(both.alias(o))
    return joined.select(*df.columns, *out, *totals)


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Row number from 1 in order_by inside partition_by, and the row count of the key."""
    ones = df.withColumn("_unit", F.lit(1).cast("long"))
    numbered = running(
        ones,
        {name: ("_unit", "sum")},
        order_by,
        partition_by,
        totals={total: ("_unit", "sum")} if total else None,
        cut_from=df,
    )
    return numbered.drop("_unit")


def trailing(
    df: DataFrame,
    build: Callable[[Callable[[int], Window], Window], dict[str, Column]],
    reach: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    number: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Frames over at most `reach` preceding rows, for keys of any size.

    Numbered rows are cut into equal chunks; a row is sent to every later chunk
    that its frames reach, where it is seen and then left out.
    build(frame, order) gets frame(k), the last k rows, and the plain ordering.
    number and total name columns for the row number and the row count of the key.
    """
    numbered = number_rows(df, order_by, partition_by, "_rn", total)
    own = F.floor((F.col("_rn") - 1) / chunk_rows)
    last = F.floor((F.col("_rn") - 1 + reach) / chunk_rows)
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(F.col("_own"), last)))
    order = Window.partitionBy(*partition_by, "_chunk").orderBy("_rn")
    columns = build(lambda rows: order.rowsBetween(1 - rows, 0), order)
    framed = spread.select("*", *[expr.alias(name) for name, expr in columns.items()])
    own_rows = framed.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")
    return own_rows.withColumnRenamed("_rn", number) if number else own_rows.drop("_rn")
