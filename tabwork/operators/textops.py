"""Rule-based text analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabwork.functions import fixed
from tabwork.functions.textfeat import contained, strip
from tabwork.operators.ordered import number_rows

WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}_]+"
MARK = "\x01"


def _confidence(base: float, points: Column) -> Column:
    return F.least(F.lit(0.9), points * 0.1 + base)


def sentiment(df: DataFrame, col: str) -> DataFrame:
    """Label by word hits and a confidence that grows with the margin."""
    margin = contained(F.col(col), fixed.POSITIVE) - contained(F.col(col), fixed.NEGATIVE)
    wide = df.withColumn("_m", margin)
    label = F.when(F.col("_m") > 0, "positive").when(F.col("_m") < 0, "negative").when(F.col("_m") == 0, "neutral")
    sure = F.when(F.col("_m") == 0, 0.5).otherwise(_confidence(0.6, F.abs("_m")))
    return wide.withColumns({"sentiment": label, "confidence": sure}).drop("_m")


def _best(df: DataFrame, scores: Mapping[str, Column], default: str) -> DataFrame:
    """Category of the highest score, the first one on ties, the default when all are 0."""
    wide = df.withColumn("_s", F.array(*scores.values())).withColumn("_top", F.array_max("_s"))
    at = F.array_position("_s", F.col("_top")).cast("int")
    category = F.when(F.col("_top") > 0, F.element_at(F.array(*[F.lit(c) for c in scores]), at)).when(
        F.col("_top").isNotNull(), default
    )
    return wide.withColumns({"category": category, "confidence": _confidence(0.5, F.col("_top"))}).drop("_s", "_top")


def classify_text(df: DataFrame, col: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Topic by keyword hits: the five topics and 'other', or the caller's categories with the first as default."""
    if categories is None:
        table, default = fixed.TOPIC_KEYWORDS, "other"
    else:
        table = {c: fixed.CATEGORY_KEYWORDS.get(c.lower(), (c.lower(),)) for c in categories}
        default = categories[0]
    return _best(df, {c: contained(F.col(col), words) for c, words in table.items()}, default)


def _marked_pieces(text: Column, pattern: str, k: int) -> Column:
    """The text split at marks set around the first k matches: every second piece is a match."""
    marked = F.regexp_replace(F.translate(text, MARK, " "), pattern, MARK + "$0" + MARK)
    return F.split(marked, MARK, 2 * k + 1)


def _entities(pieces: Column, kind: str, k: int) -> Column:
    """Structs with offsets: the lengths of the pieces before a match give its start."""
    count = F.least(F.lit(k), F.floor(F.size(pieces) / 2).cast("int"))

    def entity(i):
        start = F.aggregate(F.slice(pieces, 1, i * 2 - 1), F.lit(0), lambda n, p: n + F.length(p))
        word = F.element_at(pieces, i * 2)
        return F.struct(
            word.alias("entity"), F.lit(kind).alias("type"), start.alias("start"), (start + F.length(word)).alias("end")
        )

    empty = F.array().cast("array<struct<entity:string,type:string,start:int,end:int>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), entity)).otherwise(empty)


def extract_entities(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Capitalised names, dates and money with offsets: the first k, names before dates before money."""
    kinds = {"PERSON": fixed.NAME_ENTITY, "DATE": fixed.DATE_ENTITY, "MONEY": fixed.MONEY_ENTITY}
    # the pieces come out of a generator, so a later filter on the entities is not rewritten to run the patterns
    # again for each use; later kinds are looked for only where fewer than k were found
    wide, room = df, F.lit(True)
    for kind, p in kinds.items():
        pieces = F.when(room, _marked_pieces(F.col(col), p, k)).otherwise(F.array().cast("array<string>"))
        wide = wide.select("*", F.inline(F.array(F.struct(pieces.alias(f"_{kind}")))))
        room = room & (F.size(f"_{kind}") <= 2 * k)
    found = F.concat(*[_entities(F.col(f"_{kind}"), kind, k) for kind in kinds])
    return wide.withColumn("entities", F.slice(found, 1, k)).drop(*[f"_{kind}" for kind in kinds])


def summarize(df: DataFrame, col: str, mode: str = "ends") -> DataFrame:
    """First and last sentence ('ends'), or first, middle and last of the longer ones ('three')."""
    text = F.col(col)
    if mode == "ends":
        parts = F.split(text, r"\.")
        summary = F.when(F.size(parts) <= 2, text).otherwise(
            F.concat(F.element_at(parts, 1), F.lit(". "), F.element_at(parts, -1))
        )
        return df.withColumns({"summary": strip(summary), "compression_ratio": _ratio(summary, text)})
    wide = df.withColumn("_p", F.filter(F.transform(F.split(text, r"\."), strip), lambda x: F.length(x) > 10))
    n = F.size("_p")
    ends = (F.element_at("_p", 1), F.lit(". "), F.element_at("_p", -1))
    middle = F.get(F.col("_p"), F.floor(n / 2).cast("int"))
    short = strip(
        F.when(n <= 2, text)
        .when(n <= 5, F.concat(*ends))
        .otherwise(F.concat(F.element_at("_p", 1), F.lit(". "), middle, F.lit(". "), F.element_at("_p", -1)))
    )
    summary = F.when(F.endswith(short, F.lit(".")), short).otherwise(F.concat(short, F.lit(".")))
    return wide.withColumn("summary", summary).withColumn("compression_ratio", _ratio(F.col("summary"), text)).drop("_p")


def _ratio(summary: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(summary) / F.length(text)).otherwise(1.0)


def plain_words(c: Column) -> Column:
    """Lower-case words of three letters or more, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def top_words(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The k most common words of the corpus; equal counts in word order."""
    words = df.select(F.explode(plain_words(F.col(col))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def topics(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The corpus word that occurs most often in each text, and a confidence."""
    top = top_words(df, col, k)
    listed = top.agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "word"))), lambda s: s["word"]).alias("w")
    ).scalar()
    wide = df.withColumn("_w", listed).withColumn("_low", F.lower(F.col(col)))
    low, gone = F.length("_low"), lambda w: F.length(F.replace(F.col("_low"), w, F.lit("")))
    counts = F.transform(F.col("_w"), lambda w: ((low - gone(w)) / F.length(w)).cast("bigint"))
    wide = wide.withColumn("_c", counts).withColumn("_top", F.array_max("_c"))
    topic = F.try_element_at(F.col("_w"), F.array_position("_c", F.col("_top")).cast("int"))
    return wide.withColumns(
        {"topic": F.coalesce(topic, F.lit("general")), "confidence": _confidence(0.5, F.coalesce("_top", F.lit(0)))}
    ).drop("_w", "_low", "_c", "_top")


def _top_per_text(words: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """The k most frequent words of each text, first position on ties, as one array.

    The texts come dealt by their key, which is then the only exchange: no word is shuffled.
    """
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "pos")  # the distinct words of one text
    best = counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    packed = F.array_sort(F.collect_list(F.struct("_r", "word")))
    return best.groupBy(key).agg(F.transform(packed, lambda s: s["word"]).alias(name))


def keywords(df: DataFrame, key: str, col: str, k: int = 5) -> DataFrame:
    """(key, keywords): the most frequent words of each text without stop words."""
    words = df.select(key, col).repartition(key).select(key, F.posexplode(plain_words(F.col(col))).alias("pos", "word"))
    return _top_per_text(words.filter(~F.col("word").isin(fixed.STOP_WORDS)), key, k, "keywords")


def key_phrases(df: DataFrame, key: str, col: str, k: int = 3) -> DataFrame:
    """(key, phrases): the most frequent pairs of neighbouring words, neither a stop word."""
    words = df.select(key, col).repartition(key).select(key, plain_words(F.col(col)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))
    rows = words.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", "p.a", "p.b")
    kept = rows.filter(F.col("b").isNotNull() & ~F.col("a").isin(fixed.STOP_WORDS) & ~F.col("b").isin(fixed.STOP_WORDS))
    return _top_per_text(kept.select(key, "pos", F.concat_ws(" ", "a", "b").alias("word")), key, k, "phrases")


def detect_language(df: DataFrame, col: str) -> DataFrame:
    """Vote of frequent words per language; the share of the hits is the confidence, 'unknown' without hits."""
    tokens = F.regexp_extract_all(F.lower(F.col(col)), F.lit(TOKEN), 0)
    wide = df.withColumn("_t", tokens)
    hits = [
        F.size(F.filter("_t", _in_list(words))).alias(code) for code, words in fixed.LANGUAGE_WORDS.items()
    ]
    wide = wide.withColumn("_h", F.array(*hits)).withColumn("_top", F.array_max("_h"))
    total = F.aggregate("_h", F.lit(0), lambda a, b: a + b)
    code = F.element_at(F.array(*[F.lit(c) for c in fixed.LANGUAGE_WORDS]), F.array_position("_h", F.col("_top")).cast("int"))
    return wide.withColumns(
        {
            "language": F.when(F.col("_top") > 0, code).otherwise("unknown"),
            "confidence": F.coalesce(F.try_divide(F.col("_top").cast("double"), total), F.lit(0.0)),
        }
    ).drop("_t", "_h", "_top")


def _in_list(words: Sequence[str]):
    return lambda w: w.isin(list(words))


def embed_hash(df: DataFrame, col: str, dim: int = 384) -> DataFrame:
    """Hashed term counts of unit length: a repeatable vector per text."""
    from pyspark.ml.feature import HashingTF, Normalizer

    words = df.withColumn("_w", F.coalesce(F.regexp_extract_all(F.lower(F.col(col)), F.lit(TOKEN), 0), F.array().cast("array<string>")))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(words)
    return Normalizer(inputCol="_tf", outputCol="embedding").transform(counted).drop("_w", "_tf")


def prompt_batches(df: DataFrame, key: str, col: str, size: int = 10) -> DataFrame:
    """(batch, n, prompt): texts in key order, numbered from 1 inside batches of fixed size."""
    numbered = number_rows(df.select(key, col), [key], name="_rn")
    at = F.floor((F.col("_rn") - 1) / size)
    lines = F.concat((F.col("_rn") - at * size).cast("string"), F.lit(". "), F.coalesce(F.col(col), F.lit("")))
    packed = F.array_sort(F.collect_list(F.struct("_rn", "_line")))
    return (
        numbered.withColumn("_line", lines)
        .groupBy(at.alias("batch"))
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(packed, lambda s: s["_line"]), "\n").alias("prompt"))
    )


def parse_responses(df: DataFrame, col: str, item: str, limit: str | None = None) -> DataFrame:
    """Rows of the results array of a JSON answer, cut to the expected number; item is a schema string.

    An answer that does not parse gives no rows.
    """
    results = F.from_json(F.col(col), f"results array<struct<{item}>>")["results"]
    kept = F.slice(results, F.lit(1), F.col(limit).cast("int")) if limit else results
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(kept).alias("position", "_r")).select(*rest, "position", "_r.*")


def map_texts(
    df: DataFrame, col: str, fn: Callable[[Sequence[str]], Iterable], name: str, kind: str, fallback: Callable[[str], object] | None = None
) -> DataFrame:
    """Apply a caller's function to Arrow batches of texts; a batch that fails takes the rule per text."""
    columns = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches):
        for pdf in batches:
            texts = pdf[col].tolist()
            try:
                values = list(fn(texts))
                if len(values) != len(texts):
                    raise ValueError("one result per text is needed")
            except Exception:
                if fallback is None:
                    raise
                values = [fallback(x) for x in texts]
            out = pdf[columns].copy()
            out[name] = pd.Series(values, index=out.index)
            yield out

    return df.mapInPandas(run, schema)


def tag_sections(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, section_no, tag, section): blank-line sections with a tag word; untagged ones are left out."""
    sections = df.select(key, F.posexplode(F.split(F.col(col), "\n\n")).alias("section_no", "section"))
    low = F.lower("section")
    tag = None
    for name, words in fixed.SECTION_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return sections.select(key, "section_no", tag.alias("tag"), strip(F.col("section")).alias("section")).filter("tag is not null")


def results_table(results: DataFrame) -> DataFrame:
    """Text results with arrays and structs as JSON text, ready for a flat file."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in results.schema.fields
    ]
    return results.select(*flat)


def text_run_metrics(df: DataFrame, measure: Column, prefix: str) -> DataFrame:
    """Texts and mean, least and greatest of a per-text figure (compression ratio, entity count, length)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.avg(measure).alias(f"avg_{prefix}"),
        F.min(measure).cast("double").alias(f"min_{prefix}"),
        F.max(measure).cast("double").alias(f"max_{prefix}"),
    )
