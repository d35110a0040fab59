"""Text feature expressions. Null text gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabwork.functions import fixed

# letters and digits of any script; the plain \w of Java knows ASCII only
PUNCTUATION = r"[^\p{L}\p{N}_\s]"
WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Both ends without white space of any kind; trim takes blanks only."""
    return F.btrim(c, F.lit(WHITE))


def whole(c: Column) -> Column:
    return c.cast("bigint")


def hits(c: Column, pattern: str) -> Column:
    return whole(F.regexp_count(c, F.lit(pattern)))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def joined_length(ws: Column) -> Column:
    return F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))


def text_counts(col: str) -> dict[str, Column]:
    """Words, characters, distinct words and mean word length."""
    ws = words(F.col(col))
    mean = F.when(F.size(ws) > 0, joined_length(ws) / F.size(ws)).when(F.col(col).isNotNull(), 0.0)
    return {
        f"{col}_word_count": whole(F.when(F.col(col).isNotNull(), F.size(ws))),
        f"{col}_char_count": whole(F.length(col)),
        f"{col}_unique_words": whole(F.when(F.col(col).isNotNull(), F.size(F.array_distinct(ws)))),
        f"{col}_avg_word_length": mean,
    }


def char_class_counts(col: str) -> dict[str, Column]:
    c = F.col(col)
    classes = {
        "uppercase": "[A-Z]",
        "lowercase": "[a-z]",
        "digit": "[0-9]",
        "punctuation": PUNCTUATION,
        "whitespace": r"\s",
        "special_char": fixed.SPECIAL,
    }
    return {f"{col}_{k}_count": hits(c, p) for k, p in classes.items()}


def mark_counts(col: str) -> dict[str, Column]:
    marks = {"exclamation": "!", "question": r"\?", "period": r"\.", "comma": ","}
    return {f"{col}_{k}_count": hits(F.col(col), p) for k, p in marks.items()}


def char_ratios(col: str) -> dict[str, Column]:
    classes = {"uppercase": "[A-Z]", "digit": "[0-9]", "punctuation": PUNCTUATION}
    return {f"{col}_{k}_ratio": hits(F.col(col), p) / (F.length(col) + 1.0) for k, p in classes.items()}


def sentence_stats(col: str) -> dict[str, Column]:
    c = F.col(col)
    sentences = hits(c, "[.!?]+")
    per = F.when(c.isNotNull(), F.size(words(c)) / (sentences + 1.0))
    return {f"{col}_sentence_count": sentences, f"{col}_avg_sentence_length": per}


def content_flags(col: str) -> dict[str, Column]:
    """Rows with a URL, e-mail address, phone number, hashtag or mention; null is 0."""
    kinds = {"url": fixed.URL, "email": fixed.EMAIL, "phone": fixed.PHONE, "hashtag": fixed.HASHTAG, "mention": fixed.MENTION}
    return {f"{col}_has_{k}": whole(F.coalesce(F.col(col).rlike(p), F.lit(False))) for k, p in kinds.items()}


def shape_flags(col: str) -> dict[str, Column]:
    """Leading capital, closing mark on the first line's end, all upper or all lower case."""
    c = F.col(col)
    return {
        f"{col}_starts_with_capital": whole(c.rlike(r"^[A-Z]")),
        f"{col}_ends_with_punctuation": whole(c.rlike(r"^[^\n]*[.!?]\n?\z")),
        f"{col}_all_caps": whole((c == F.upper(c)) & (c != F.lower(c))),
        f"{col}_all_lower": whole((c == F.lower(c)) & (c != F.upper(c))),
    }


def contained(c: Column, listed) -> Column:
    """How many of the listed words occur anywhere in the lower-cased text."""
    low = F.lower(c)
    return sum((whole(F.contains(low, F.lit(w))) for w in listed), F.lit(0).cast("bigint"))


def sentiment_score(col: str) -> dict[str, Column]:
    good, bad = contained(F.col(col), fixed.FEATURE_POSITIVE), contained(F.col(col), fixed.FEATURE_NEGATIVE)
    return {f"{col}_positive_words": good, f"{col}_negative_words": bad, f"{col}_sentiment_score": good - bad}


def avg_syllables(col: str) -> dict[str, Column]:
    """Vowel groups per word, less a closing e, one at least; letterless words count in the divisor only."""
    ws = words(F.lower(F.col(col)))

    def syllables(w):
        letters = F.regexp_replace(w, "[^a-z]", "")
        groups = F.regexp_count(letters, F.lit("[aeiouy]+")) - F.endswith(letters, F.lit("e")).cast("int")
        return F.when(letters == "", 0).otherwise(F.greatest(groups, F.lit(1)))

    total = F.aggregate(ws, F.lit(0), lambda n, w: n + syllables(w))
    mean = F.when(F.size(ws) > 0, total / F.size(ws)).when(F.col(col).isNotNull(), 0.0)
    return {f"{col}_avg_syllables": mean}


def flesch(col: str) -> dict[str, Column]:
    per = sentence_stats(col)[f"{col}_avg_sentence_length"]
    syl = avg_syllables(col)[f"{col}_avg_syllables"]
    return {f"{col}_flesch_score": 206.835 - per * 1.015 - syl * 84.6}


def standardize(c: Column) -> Column:
    return F.lower(strip(c))


def match_key(c: Column) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.regexp_replace(F.lower(strip(c)), PUNCTUATION, "")


def clean_text(col: str) -> Column:
    """E-mail columns lower, phone columns digits only, other text trimmed title case.

    initcap starts a word after a space only.
    """
    name, c = col.lower(), strip(F.col(col))
    if "email" in name:
        return F.lower(c)
    if "phone" in name:
        return F.regexp_replace(c, "[^0-9]", "")
    return F.initcap(c)


def combine_text(cols) -> Column:
    """Columns joined by spaces; null is the empty text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def preview_text(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
