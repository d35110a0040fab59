"""Fixed values that results depend on: patterns, word lists, thresholds."""

# fixed values: row-flag patterns of text columns
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
SPECIAL = r'[!@#$%^&*(),.?":{}|<>]'
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*$,]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
HASHTAG = r"#[\p{L}\p{N}_]+"
MENTION = r"@[\p{L}\p{N}_]+"

# fixed values: words of the sentiment feature columns
FEATURE_POSITIVE = "good great excellent amazing wonderful fantastic love like best awesome perfect".split()
FEATURE_NEGATIVE = "bad terrible awful horrible hate worst dislike poor disappointing annoying".split()

# fixed values: semantic classes by column-name keyword, first match wins
# (keywords, semantic type, business meaning, data category, privacy level)
SEMANTIC_RULES = (
    (("id", "identifier", "key"), "Identifier", "Unique identifier for records", "General", "Public"),
    (("name", "title", "label"), "Name", "Descriptive name or title", "General", "Public"),
    (("email", "mail"), "Email", "Email address", "Personal", "Confidential"),
    (("phone", "tel", "mobile"), "Phone", "Phone number", "Personal", "Confidential"),
    (("date", "time", "created", "updated"), "DateTime", "Date or timestamp information", "General", "Public"),
    (("amount", "price", "cost", "value", "salary"), "Amount", "Monetary or numeric value", "Financial", "Public"),
)
SEMANTIC_BY_KIND = (
    ("number", "Numeric", "Numeric measurement or count"),
    ("text", "Text", "Text or categorical data"),
)
SEMANTIC_DEFAULT = ("General", "General data column")

# fixed values: enrichment potential by column-name keyword
ENRICH_RULES = (
    (("name", "title", "description", "text", "comment"), "Text data suitable for NLP enrichment"),
    (("email", "phone", "address", "location"), "Contact data suitable for validation and standardization"),
    (("date", "time", "created", "updated"), "Temporal data suitable for time-based features"),
)

# fixed values: name keywords of time columns and of sensitive attributes
TIME_NAMES = ("date", "time", "year", "month", "day", "timestamp")
SENSITIVE_NAMES = ("email", "phone", "ssn", "id", "name", "address")
DEMOGRAPHIC_NAMES = ("age", "gender", "race", "ethnicity", "religion", "nationality")
GEOGRAPHIC_NAMES = ("zip", "postal", "city", "state", "country", "address")

# fixed values: marks of damaged text values
BAD_MARKS = ("?", "#", "NULL", "null", "N/A", "n/a")

# fixed values: words of rule sentiment
POSITIVE = "good great excellent amazing wonderful fantastic love like".split()
NEGATIVE = "bad terrible awful hate dislike horrible worst".split()

# fixed values: topic keywords, in order of preference on ties
TOPIC_KEYWORDS = {
    "business": ("business", "company", "market", "finance", "economy", "profit", "revenue"),
    "technology": ("technology", "software", "computer", "ai", "digital", "tech", "innovation"),
    "sports": ("sports", "game", "team", "player", "match", "score", "championship"),
    "entertainment": ("movie", "music", "celebrity", "entertainment", "show", "actor", "film"),
    "politics": ("politics", "government", "election", "policy", "political", "vote", "democracy"),
}

# fixed values: keywords of the categories a caller may name; another category is its own keyword
CATEGORY_KEYWORDS = {
    "positive": ("good", "great", "excellent", "amazing", "wonderful", "love", "best", "awesome"),
    "negative": ("bad", "terrible", "awful", "hate", "worst", "horrible", "disappointing"),
    "neutral": ("okay", "fine", "average", "normal"),
    "business": ("company", "business", "corporate", "enterprise", "organization"),
    "technology": ("tech", "software", "computer", "digital", "ai", "data"),
    "sports": ("game", "team", "player", "match", "sport", "championship"),
    "entertainment": ("movie", "music", "show", "entertainment", "fun"),
}

# fixed values: words left out of keywords and phrases
STOP_WORDS = (
    "the and or but in on at to for of with by is are was were be been have has had do does did "
    "will would could should may might must can this that these those"
).split()

# fixed values: entity patterns (a word edge is where no letter, digit or underscore touches)
NAME_ENTITY = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"
DATE_ENTITY = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
MONEY_ENTITY = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"

# frequent short words per language, for the language vote
LANGUAGE_WORDS = {
    "en": "the and of to in is that for it with as was on are be this by from have not".split(),
    "fr": "le la les des et est une dans que pour qui sur pas avec plus du au ce il sont".split(),
    "de": "der die das und ist nicht ein eine mit den von zu auf im dem sich auch als wird des".split(),
    "es": "el los las una del por con para es en que no se su al lo como y o son".split(),
}

# fixed values: section tags by keyword, first match wins
SECTION_RULES = (
    ("insight", ("insight", "pattern", "trend")),
    ("recommendation", ("recommend", "suggest", "should")),
    ("etl_action", ("etl", "pipeline", "transform")),
    ("code_suggestion", ("code", "script", "function")),
)
