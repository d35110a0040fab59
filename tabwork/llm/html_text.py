"""Main text of web pages: flat text blocks, features of each block and its neighbours, a decision tree.

Each page is cut into flat blocks in one narrow pass (no shuffle): a block is the
text between two block-level tags, with its word count, the share of its words
inside links, the same two figures of the block before and after it, its tag kind
and its zone. The zone comes from the markup: `main` inside article/main (or
role main/article), `boiler` inside nav, header, footer, aside, form and the like
or inside an element whose class, id or role names a menu, advert, notice,
comment section and such, `none` elsewhere. Scripts, styles and other non-text
elements, comments and the head are never text.

A decision tree (Spark ML) is trained on a small labelled table: the blocks of at
most TRAIN_PAGES pages chosen by a hash of page_id, main blocks labelled 1 and
boiler blocks 0, on the shape features only (never the zone). The fitted tree is
turned into one Column expression and applied with `filter` over each page's
array of blocks, so the classification runs inside the JVM with no shuffle.

A page keeps its main blocks when it has any; a page without an article keeps the
`none` blocks that the tree calls content. Boiler blocks always go.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tabwork.llm.blocks import narrow_batches

TRAIN_PAGES = 2000  # bound of the labelled table: blocks of at most this many pages
TREE_DEPTH = 5

# Element names of the parse.
SKIP = ("script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "button", "textarea", "canvas", "math")
MAIN = ("article", "main")
BOILER = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
# Tokens of class, id or role that mark an element as boilerplate, and roles of the article.
BOILER_TOKENS = (
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert",
    "comment", "comments", "reply", "replies", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "header", "breadcrumb",
    "breadcrumbs", "share", "social", "related", "subscribe", "newsletter", "popup", "modal", "disclaimer", "contentinfo", "complementary",
    "search", "widget",
)
MAIN_ROLES = ("main", "article")

KIND = {"other": 0, "heading": 1, "paragraph": 2, "item": 3}
FEATURES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density", "kind", "marks")
BLOCK_TYPE = pa.struct([
    ("text", pa.string()), ("zone", pa.string()), ("words", pa.int64()), ("density", pa.float64()), ("prev_words", pa.int64()),
    ("prev_density", pa.float64()), ("next_words", pa.int64()), ("next_density", pa.float64()), ("kind", pa.int64()), ("marks", pa.int64()),
])
_TOKEN = re.compile(r"[a-z0-9]+")
_MARK = re.compile(r"[.!?]")


class _Blocks(HTMLParser):
    """Flat blocks of one page: (text, zone, words, link words, kind)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int]] = []  # (tag, skip, main, boiler) added by each open element
        self.skip = self.main = self.boiler = self.link = 0
        self.parts: list[str] = []
        self.link_words = 0
        self.kind = "other"
        self.blocks: list[tuple[str, str, int, int, str]] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            zone = "boiler" if self.boiler else "main" if self.main else "none"
            self.blocks.append((text, zone, len(text.split(" ")), self.link_words, self.kind))
        self.parts, self.link_words, self.kind = [], 0, "other"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        marks = {t for k, v in attrs if k in ("class", "id", "role") and v for t in _TOKEN.findall(v.lower())}
        role = next((v.lower() for k, v in attrs if k == "role" and v), "")
        is_boiler = tag in BOILER or bool(marks & set(BOILER_TOKENS)) and role not in MAIN_ROLES
        is_main = tag in MAIN or role in MAIN_ROLES
        if tag in BLOCK or is_boiler or is_main or tag in SKIP:
            self._flush()
        if tag in HEADING:
            self.kind = "heading"
        elif tag == "p":
            self.kind = "paragraph"
        elif tag == "li":
            self.kind = "item"
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        added = (tag, int(tag in SKIP), int(is_main), int(is_boiler))
        self.open.append(added)
        self.skip, self.main, self.boiler = self.skip + added[1], self.main + added[2], self.boiler + added[3]
        if tag == "a":
            self.link += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in SKIP or tag in MAIN or tag in BOILER:
            self._flush()
        if not any(t == tag for t, *_ in self.open):  # a stray end tag closes nothing
            return
        while self.open:
            name, skip, main, boiler = self.open.pop()
            self.skip, self.main, self.boiler = self.skip - skip, self.main - main, self.boiler - boiler
            if name == "a":
                self.link = max(self.link - 1, 0)
            if skip or main or boiler:
                self._flush()
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.parts.append(data)
        if self.link:
            self.link_words += len(data.split())


def page_blocks(html: str | None) -> list[dict]:
    """Blocks of one page in page order with the features of their neighbours; none for a null or empty page."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    raw = parser.blocks
    out = []
    for i, (text, zone, words, link_words, kind) in enumerate(raw):
        prev, nxt = raw[i - 1] if i else None, raw[i + 1] if i + 1 < len(raw) else None
        out.append({
            "text": text, "zone": zone, "words": words, "density": min(link_words / words, 1.0), "kind": KIND[kind],
            "prev_words": prev[2] if prev else 0, "prev_density": min(prev[3] / prev[2], 1.0) if prev else 0.0,
            "next_words": nxt[2] if nxt else 0, "next_density": min(nxt[3] / nxt[2], 1.0) if nxt else 0.0,
            "marks": len(_MARK.findall(text)),
        })
    return out


def _cut(batches):
    for batch in batches:
        blocks = [page_blocks(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_page_id"), batch.column("_url"), pa.array(blocks, pa.list_(BLOCK_TYPE))], names=["_page_id", "_url", "blocks"],
        )


def with_blocks(pages: DataFrame) -> DataFrame:
    """_page_id, _url and the array of blocks of each page; one narrow pass, no shuffle."""
    narrow_batches(pages)
    rows = pages.select(F.col("page_id").alias("_page_id"), F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("html"))
    fields = ", ".join(f"{f.name}: {'string' if pa.types.is_string(f.type) else 'double' if pa.types.is_floating(f.type) else 'long'}" for f in BLOCK_TYPE)
    schema = f"_page_id {rows.schema['_page_id'].dataType.simpleString()}, _url string, blocks array<struct<{fields}>>"
    return rows.mapInArrow(_cut, schema)


def labelled_table(pages: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """Blocks of at most `limit` pages chosen by a hash of page_id and url, labelled 1 (main) or 0 (boiler).

    A hash filter first keeps about four times `limit` pages (all of a small table), so
    that the ordered limit after it and the parse see a bounded number of pages.
    """
    total = pages.count()
    keep = min(1.0, 4.0 * limit / max(total, 1))
    h = F.xxhash64("page_id", "url")
    chosen = pages.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(keep * (1 << 30)) + 1)).withColumn("_h", h).orderBy("_h", "page_id").limit(limit)
    blocks = with_blocks(chosen.drop("_h")).select(F.explode("blocks").alias("b")).where(F.col("b.zone").isin("main", "boiler"))
    return blocks.select(*[F.col(f"b.{f}").cast("double").alias(f) for f in FEATURES], (F.col("b.zone") == "main").cast("double").alias("label"))


def fit_tree(table: DataFrame, depth: int = TREE_DEPTH):
    """A decision tree over FEATURES, or None when the table lacks one of the two classes."""
    counts = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, seed=7, labelCol="label", featuresCol="features").fit(vectors)


_IF = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_PREDICT = re.compile(r"Predict: (\S+)")


def tree_column(model, block: Column) -> Column:
    """The fitted tree as one boolean Column over the fields of a block struct (true: content).

    Read from the model's printed form, which lists each split as `If (feature i <= t)`,
    its other branch as `Else`, and each leaf as `Predict: c`.
    """
    lines = [ln.strip() for ln in model.toDebugString.splitlines()[1:] if ln.strip()]
    pos = 0

    def node() -> Column:
        nonlocal pos
        line = lines[pos]
        pos += 1
        leaf = _PREDICT.match(line)
        if leaf:
            return F.lit(float(leaf.group(1)) == 1.0)
        split = _IF.match(line)
        feature, threshold = FEATURES[int(split.group(1))], float(split.group(2))
        left = node()
        pos += 1  # the Else line
        right = node()
        return F.when(block[feature].cast("double") <= threshold, left).otherwise(right)

    return node()


def extract_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """Main text of every page: page_id, url, text (blocks joined by one space, empty if none), n_chars (code points).

    A null or empty html gives an empty text; rows are never dropped or merged, so repeated
    pages give repeated rows and null page_ids stay. Only page_id, url and html are read, so
    other columns of any name do not clash. With no labelled blocks of both kinds in the
    sample (an empty table, pages without markup), blocks outside any article are all kept.
    """
    model = fit_tree(labelled_table(pages, train_pages))
    paged = with_blocks(pages)
    content = (lambda b: tree_column(model, b)) if model is not None else (lambda b: F.lit(True))
    has_main = F.exists("blocks", lambda b: b["zone"] == "main")
    keep = F.filter("blocks", lambda b: F.when(has_main, b["zone"] == "main").otherwise((b["zone"] == "none") & content(b)))
    text = F.array_join(F.transform(keep, lambda b: b["text"]), " ")
    out = paged.select(F.col("_page_id").alias("page_id"), F.col("_url").alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
