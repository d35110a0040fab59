"""Text analysis over all documents and conversations."""

from pyspark.sql import functions as F

from entries import query
from entries.features import contained
from tabwork.functions import fixed
from tabwork.operators import profile as p, textops as x

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# accented letters become word characters that match no pattern, so that the ASCII word edge of the SQL engine is right
ACCENT = r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]"
def edged(text):
    return f"regexp_replace({text}, '{ACCENT}', '_', 'g')"


LOW = edged("lower(text)")
PLAIN = f"regexp_extract_all({LOW}, '\\b[a-z]{{3,}}\\b')"
STOP = "(" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + ")"

MARGIN = f"({contained(fixed.POSITIVE)} - {contained(fixed.NEGATIVE)})"
SENTIMENT = f"""(select doc_id, case when m > 0 then 'positive' when m < 0 then 'negative' else 'neutral' end as sentiment,
  case when m = 0 then 0.5 else least(0.9, 0.6 + abs(m) * 0.1) end as confidence from (select doc_id, {MARGIN} as m from documents))"""


@query("sentiment", f"select * from {SENTIMENT}", dbl="confidence")
def _(t):
    return x.sentiment(t.documents, "text").select("doc_id", "sentiment", "confidence")


def classes(table, default):
    scores = ", ".join(f"{contained(words)} as s{i}" for i, words in enumerate(table.values()))
    top = f"greatest({', '.join(f's{i}' for i in range(len(table)))})"
    picks = " ".join(f"when s{i} = {top} then '{c}'" for i, c in enumerate(table))
    return f"""(select doc_id, case when {top} = 0 then '{default}' {picks} end as category, least(0.9, 0.5 + 0.1 * {top}) as confidence
      from (select doc_id, {scores} from documents))"""


@query("classify_text", f"select * from {classes(fixed.TOPIC_KEYWORDS, 'other')}", dbl="confidence")
def _(t):
    return x.classify_text(t.documents, "text").select("doc_id", "category", "confidence")


CALLER = ["Sports", "Technology", "license"]
CALLER_TABLE = {"Sports": fixed.CATEGORY_KEYWORDS["sports"], "Technology": fixed.CATEGORY_KEYWORDS["technology"], "license": ("license",)}


@query("classify_text_categories", f"select * from {classes(CALLER_TABLE, 'Sports')}", dbl="confidence")
def _(t):
    return x.classify_text(t.documents, "text", CALLER).select("doc_id", "category", "confidence")


def matches(pattern, kind, source="text"):
    marked = f"string_split(regexp_replace(translate({source}, chr(1), ' '), '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"""(select doc_id, list_transform(range(1, len(p) // 2 + 1), lambda i: {{'e': p[2 * i], 't': '{kind}',
      's': list_sum(list_transform(p[1:2 * i - 1], lambda q: length(q)))}}) as m from (select doc_id, {marked} as p from documents))"""


NAMES = matches(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "PERSON", edged("text"))
DATES = matches(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", "DATE")
MONEY = matches(r"\$\d+(?:,\d{3})*(?:\.\d{2})?", "MONEY")
ENTITIES = f"(select doc_id, list_concat(list_concat(a.m, b.m), c.m)[1:5] as e from {NAMES} a join {DATES} b using (doc_id) join {MONEY} c using (doc_id))"


@query(
    "extract_entities",
    f"""select doc_id, i as position, e[i].e as entity, e[i].t as type, e[i].s::bigint as start, e[i].s::bigint + length(e[i].e) as "end"
    from (select doc_id, e, unnest(range(1, len(e) + 1)) as i from {ENTITIES})""",
)
def _(t):
    found = x.extract_entities(t.documents, "text")
    return found.select("doc_id", F.posexplode("entities").alias("p", "e")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "e.entity", "e.type",
        F.col("e.start").cast("bigint").alias("start"), F.col("e.end").cast("bigint").alias("end"),
    )


ENDS = """(select doc_id, text, case when len(p) <= 2 then text else p[1] || '. ' || p[-1] end as s from (select *, string_split(text, '.') as p from documents))"""


@query("summarize_ends", f"select doc_id, trim(s, {WHITE}) as summary, length(s) / length(text) as compression_ratio from {ENDS}", dbl="compression_ratio")
def _(t):
    return x.summarize(t.documents, "text").select("doc_id", "summary", "compression_ratio")


@query(
    "summarize_three",
    f"""with a as (select doc_id, text, list_filter(list_transform(string_split(text, '.'), lambda q: trim(q, {WHITE})), lambda q: length(q) > 10) as p from documents),
    b as (select doc_id, text, trim(case when len(p) <= 2 then text when len(p) <= 5 then p[1] || '. ' || p[-1] else p[1] || '. ' || p[len(p) // 2 + 1] || '. ' || p[-1] end, {WHITE}) as s from a),
    c as (select doc_id, text, case when ends_with(s, '.') then s else s || '.' end as summary from b)
    select doc_id, summary, length(summary) / length(text) as compression_ratio from c""",
    dbl="compression_ratio",
)
def _(t):
    return x.summarize(t.documents, "text", "three").select("doc_id", "summary", "compression_ratio")


TOP = f"(select word, count(*) as n from (select unnest({PLAIN}) as word from documents) group by word order by n desc, word limit 5)"


@query("top_words", f"select * from {TOP}")
def _(t):
    return x.top_words(t.documents, "text")


@query(
    "topics",
    f"""with w as (select list(word order by n desc, word) as w from {TOP}),
    c as (select doc_id, w, list_transform(w, lambda q: ((length(lower(text)) - length(replace(lower(text), q, ''))) / length(q))::bigint) as c from documents, w)
    select doc_id, w[list_position(c, list_max(c))] as topic, least(0.9, 0.5 + 0.1 * list_max(c)) as confidence from c""",
    dbl="confidence",
)
def _(t):
    return x.topics(t.documents, "text").select("doc_id", "topic", "confidence")


def per_text(words, k, name):
    return f"""with w as ({words}), c as (select doc_id, word, count(*) as n, min(pos) as pos from w group by doc_id, word),
    r as (select *, row_number() over (partition by doc_id order by n desc, pos) as r from c)
    select doc_id, string_agg(word, ',' order by r) as {name} from r where r <= {k} group by doc_id"""


@query(
    "keywords",
    per_text(f"select * from (select doc_id, unnest({PLAIN}) as word, generate_subscripts({PLAIN}, 1) as pos from documents) where word not in {STOP}", 5, "keywords"),
)
def _(t):
    found = x.keywords(t.documents, "doc_id", "text")
    return found.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(
    "key_phrases",
    per_text(
        f"""select doc_id, a || ' ' || b as word, pos from (select doc_id, word as a, lead(word) over (partition by doc_id order by pos) as b, pos from
        (select doc_id, unnest({PLAIN}) as word, generate_subscripts({PLAIN}, 1) as pos from documents)) where b is not null and a not in {STOP} and b not in {STOP}""",
        3,
        "phrases",
    ),
)
def _(t):
    found = x.key_phrases(t.documents, "doc_id", "text")
    return found.select("doc_id", F.array_join("phrases", ",").alias("phrases"))


HITS = ", ".join(
    f"len(list_filter(w, lambda q: q in ({', '.join(repr(v) for v in words)}))) as h{i}" for i, words in enumerate(fixed.LANGUAGE_WORDS.values())
)
LANG_TOP = "greatest(h0, h1, h2, h3)"
LANGUAGE = f"""(select doc_id, lang, case when {LANG_TOP} = 0 then 'unknown' {' '.join(f"when h{i} = {LANG_TOP} then '{c}'" for i, c in enumerate(fixed.LANGUAGE_WORDS))} end as language,
  case when h0 + h1 + h2 + h3 = 0 then 0 else {LANG_TOP} / (h0 + h1 + h2 + h3) end as confidence
  from (select doc_id, lang, {HITS} from (select *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from documents)))"""


@query("detect_language", f"select doc_id, language, confidence from {LANGUAGE}", dbl="confidence")
def _(t):
    return x.detect_language(t.documents, "text").select("doc_id", "language", "confidence")


@query("language_agreement", f"select lang, language, count(*) as n from {LANGUAGE} group by lang, language")
def _(t):
    return x.detect_language(t.documents, "text").groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


@query("embed_hash")
def _(t):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("embedding")
    vectors = x.embed_hash(t.documents, "text")
    return vectors.select(
        "doc_id", F.size(v).alias("dimension"), F.round(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b), 6).alias("norm2")
    )


@query(
    "prompt_batches",
    """select (rn - 1) // 10 as batch, count(*) as n, string_agg(((rn - 1) % 10 + 1) || '. ' || text, chr(10) order by rn) as prompt
    from (select *, row_number() over (order by doc_id) as rn from documents) group by 1""",
)
def _(t):
    return x.prompt_batches(t.documents, "doc_id", "text", 10)


@query(
    "parse_responses",
    """select event_id, 0::bigint as position, event_type as label, value as score from events union all
    select event_id, 1, 'other', 1.5 from events where user_id % 2 = 1""",
    dbl="score",
)
def _(t):
    answer = F.to_json(
        F.struct(
            F.array(
                F.struct(F.col("event_type").alias("label"), F.col("value").alias("score")),
                F.struct(F.lit("other").alias("label"), F.lit(1.5).alias("score")),
            ).alias("results")
        )
    )
    df = t.events.select("event_id", answer.alias("answer"), (F.col("user_id") % 2 + 1).alias("expected"))
    rows = x.parse_responses(df, "answer", "label string, score double", "expected").drop("expected")
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("map_texts", "select doc_id, length(text) as length from documents")
def _(t):
    return x.map_texts(t.documents.select("doc_id", "text"), "text", lambda texts: [len(s) for s in texts], "length", "bigint").drop("text")


TAGS = " ".join(f"when {' or '.join(f'''contains(lower(s), '{w}')''' for w in words)} then '{name}'" for name, words in fixed.SECTION_RULES)


@query(
    "tag_sections",
    f"""select * from (select doc_id, no::bigint as section_no, case {TAGS} end as tag, trim(s, {WHITE}) as section from
    (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as s, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as no from documents)) where tag is not null""",
)
def _(t):
    tagged = x.tag_sections(t.documents, "doc_id", "text")
    return tagged.withColumn("section_no", F.col("section_no").cast("bigint"))


@query(
    "label_metrics",
    f"select sentiment, count(*) as texts, avg(confidence) as avg_confidence from {SENTIMENT} group by sentiment",
    dbl="avg_confidence",
)
def _(t):
    return p.label_metrics(x.sentiment(t.documents, "text"), "sentiment", "confidence")


@query(
    "compression_metrics",
    f"""select count(*) as total_texts, avg(r) as avg_compression_ratio, min(r) as min_compression_ratio, max(r) as max_compression_ratio
    from (select length(s) / length(text) as r from {ENDS})""",
    dbl="avg_compression_ratio min_compression_ratio max_compression_ratio",
)
def _(t):
    return x.text_run_metrics(x.summarize(t.documents, "text"), F.col("compression_ratio"), "compression_ratio")


@query(
    "entity_metrics",
    f"""select count(*) as total_texts, avg(len(e)) as avg_entities, min(len(e))::double as min_entities, max(len(e))::double as max_entities from {ENTITIES}""",
    dbl="avg_entities min_entities max_entities",
)
def _(t):
    return x.text_run_metrics(x.extract_entities(t.documents, "text"), F.size("entities"), "entities")


@query(
    "results_table",
    f"""select doc_id, len(e)::bigint as n, sum(length(z.e)) over (partition by doc_id)::bigint as chars from {ENTITIES}, unnest(e) as u(z)
    qualify row_number() over (partition by doc_id) = 1""",
)
def _(t):
    flat = x.results_table(x.extract_entities(t.documents, "text").select("doc_id", "entities"))
    back = F.from_json("entities", "array<struct<entity:string,type:string,start:int,end:int>>")
    chars = F.aggregate(back, F.lit(0).cast("bigint"), lambda n, e: n + F.length(e["entity"]))
    return flat.select("doc_id", F.size(back).cast("bigint").alias("n"), chars.alias("chars")).filter("n > 0")
